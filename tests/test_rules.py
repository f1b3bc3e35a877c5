"""Hand-computed cases at the edges of the rules."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.functions.rules import (
    ConfidenceRule,
    ThresholdRule,
    confidence_failure,
    first_failure,
    first_failure_array,
)
from driftwatch.operators import resets, windows
from driftwatch.schemas import CHANNELS, HEAT_DISSIPATION, OVERSTRAIN, POWER

RULE, LIMITS = ConfidenceRule(), ThresholdRule()
SPEED = 1500.0
MEAN_TORQUE = RULE.power_mean / (SPEED / 60.0 * math.pi * 2.0)
WIDE_DIFF = RULE.temp_diff_mean + RULE.critical * RULE.temp_diff_sd + 0.01
NAN = float("nan")

CONFIDENCE_CASES = [
    ("all at mean", (300.0, 310.00063, SPEED, MEAN_TORQUE, 1), None),
    ("heat just outside", (300.0, 300.0 + WIDE_DIFF, SPEED, MEAN_TORQUE, 1), HEAT_DISSIPATION),
    ("difference may have either sign", (300.0 + WIDE_DIFF, 300.0, SPEED, MEAN_TORQUE, 1), HEAT_DISSIPATION),
    ("heat comes first", (300.0, 300.0 + WIDE_DIFF, SPEED, 2 * MEAN_TORQUE, 1), HEAT_DISSIPATION),
    ("power alone", (300.0, 310.0, SPEED, 2 * MEAN_TORQUE, 1), POWER),
    ("more samples narrow the interval", (300.0, 312.5, SPEED, MEAN_TORQUE, 4), HEAT_DISSIPATION),
    ("one sample does not", (300.0, 312.5, SPEED, MEAN_TORQUE, 1), None),
    ("no samples", (300.0, 400.0, SPEED, MEAN_TORQUE, 0), None),
    ("NaN air, power fine", (NAN, 310.0, SPEED, MEAN_TORQUE, 1), None),
    ("NaN air, power outside", (NAN, 310.0, SPEED, 2 * MEAN_TORQUE, 1), POWER),
    ("NaN power", (300.0, 310.0, SPEED, NAN, 1), None),
]


@pytest.mark.parametrize("values,expected", [c[1:] for c in CONFIDENCE_CASES], ids=[c[0] for c in CONFIDENCE_CASES])
def test_confidence_rule(spark, values, expected):
    names = [*CHANNELS, "n"]
    df = spark.createDataFrame([values], "air double, process double, speed double, torque double, n long")
    assert df.select(confidence_failure(*[F.col(n) for n in names])).first()[0] == expected
    with np.errstate(all="ignore"):
        flags = RULE.conditions(*[np.array([float(v)]) for v in values], np)
    assert (first_failure_array(flags)[0] or None) == expected


THRESHOLD_CASES = [
    ("temperature difference at its limit", (8.6, 1000.0, 5000.0, 0.0), None),
    ("speed at its limit", (5.0, 1380.0, 5000.0, 0.0), None),
    ("both below", (-8.5, 1379.0, 5000.0, 0.0), HEAT_DISSIPATION),
    ("lowest power", (10.0, 1500.0, 3500.0, 0.0), None),
    ("highest power", (10.0, 1500.0, 9000.0, 0.0), None),
    ("power too low", (10.0, 1500.0, 3499.9, 20000.0), POWER),
    ("NaN power", (10.0, 1500.0, NAN, 0.0), POWER),
    ("strain at its limit", (10.0, 1500.0, 5000.0, 11000.0), None),
    ("strain above", (10.0, 1500.0, 5000.0, 11000.1), OVERSTRAIN),
    ("NaN strain", (10.0, 1500.0, 5000.0, NAN), None),
]


@pytest.mark.parametrize("values,expected", [c[1:] for c in THRESHOLD_CASES], ids=[c[0] for c in THRESHOLD_CASES])
def test_threshold_rule(spark, values, expected):
    df = spark.createDataFrame([values], "diff double, speed double, power double, strain double")
    conditions = LIMITS.conditions(*[F.col(c) for c in df.columns])
    assert df.select(first_failure(conditions)).first()[0] == expected
    assert (first_failure_array(LIMITS.conditions(*[np.array([v]) for v in values], np))[0] or None) == expected


def _motor_row(spark, channels, counts):
    columns = [F.lit(v).cast("double").alias(name) for name, v in zip(CHANNELS, channels)]
    columns += [F.lit(n).cast("bigint").alias(c) for c, n in zip(windows.COUNTS, counts)]
    return spark.range(1).select(*columns)


def test_mean_count_drops_the_fraction(spark):
    assert windows.complete(_motor_row(spark, (1, 2, 3, 4), (1, 1, 1, 4))).first().mean_n == 1


def test_missing_channel_is_incomplete(spark):
    assert windows.complete(_motor_row(spark, (1, None, 3, 4), (1, 0, 1, 1))).count() == 0


def _arrays(**columns):
    return {name: np.array(values) for name, values in columns.items()}


def test_throttle():
    seconds = [9.9, 10.0, 15.0, 20.0]
    rows = _arrays(ts_us=[int(s * 1e6) for s in seconds], reading=[1.0, 2.0, 3.0, 4.0])
    found = resets.throttled_means_step(rows, 0, size_us=5_000_000, interval_us=10_000_000)
    assert list(found["position"]) == [10_000_000, 20_000_000]
    assert found["average"] == [1.5, 3.5]
    assert list(found["n"]) == [2, 2]


def test_latest_reset_waits_for_all_channels():
    averages = [300.0, 400.0, 1500.0, 40.0]
    order = [0, 1, 2, 3, 0, 1, 2, 3]
    rows = _arrays(
        position=[8 * i + 1 + c for i, c in enumerate(order)], ts_us=list(range(8)), channel=order,
        average=[averages[c] for c in order], n=[1] * 8, fresh=[True] * 8,
    )
    found = resets.latest_slots_step(rows, -1)
    assert list(found["alert_us"]) == [3, 7]
    assert list(found["failure"]) == [HEAT_DISSIPATION] * 2


def test_trailing_reset_empties_the_ranges():
    order = [0, 1, 2, 3, 0, 1, 2, 3]
    values = {0: 300.0, 1: 302.0, 2: 1000.0, 3: 60.0}
    rows = _arrays(
        position=[8 * i + 1 + c for i, c in enumerate(order)], ts_us=list(range(8)), channel=order,
        reading=[values[c] for c in order], fresh=[True] * 8,
    )
    found = resets.trailing_reset_step(rows, 0, size_us=100, age_unit_us=1_000_000)
    assert [p >> 3 for p in found["position"]] == [3, 7]
    assert found["failure"] == [HEAT_DISSIPATION] * 2


def test_strain_at_the_reference_unit():
    """At 40 Nm the limit is passed after 275 seconds of age."""
    ends = np.arange(1, 601) * 1_000_000
    rows = {
        "position": ends, "window_us": ends - 1_000_000,
        "temperature_difference": np.full(600, 10.0), "rotational_speed": np.full(600, SPEED), "torque": np.full(600, 40.0),
    }
    found = resets.age_strain_step(rows, 0, age_unit_us=1_000_000)
    assert [p // 1_000_000 for p in found["position"]] == [276, 552]
    assert found["failure"] == [OVERSTRAIN] * 2
