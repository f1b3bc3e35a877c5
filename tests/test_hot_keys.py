"""Cutting large keys must not change any result: tiny limits against whole keys and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.functions.timegrid import SECOND_US
from driftwatch.operators import resets
from driftwatch.operators.comparison import number_runs
from driftwatch.operators.latest import latest_values
from driftwatch.operators.liveness import sensor_liveness
from driftwatch.operators.quantiles import exact_quantiles, five_number_summary
from driftwatch.operators.splitting import hot_keys
from driftwatch.operators.trailing import motor_trailing_means, sensor_trailing_means

START = 1_704_067_200 * SECOND_US
SIZE, INTERVAL = 64 * SECOND_US, 20 * SECOND_US
LIMIT = 40


@pytest.fixture(scope="module")
def rows():
    """One motor holds most of the readings; some readings share their time, one is NaN."""
    random.seed(7)
    out, event = [], 0
    for motor, count in ((0, 700), (1, 60), (2, 30), (3, 3)):
        t = START
        for _ in range(count):
            t += random.choice([1, 2, 3, 3, 5, 90]) * SECOND_US // 2
            for channel in random.sample(range(4), random.choice([1, 1, 2])):
                base = (300.0, 309.0, 1400.0, 38.0)[channel]
                out.append((event, motor * 4 + channel, t, base + random.gauss(0, 1) * (1.5, 1.5, 250.0, 9.0)[channel]))
                event += 1
    out[200] = (*out[200][:3], float("nan"))
    return out


@pytest.fixture(scope="module")
def readings(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, sensor_id long, ts_us long, reading double")
    return df.select(
        "event_id", "sensor_id", F.shiftright("sensor_id", 2).alias("motor_id"),
        F.col("sensor_id").bitwiseAND(F.lit(3).cast("bigint")).alias("channel"),
        F.timestamp_micros("ts_us").alias("ts"), "ts_us", "reading",
    ).repartition(3).cache()


def same(a, b):
    """Rows as sorted tuples of rounded text, so NaN equals NaN."""
    def text(df):
        return sorted(tuple(f"{v:.7f}" if isinstance(v, float) else str(v) for v in row) for row in df.collect())

    left, right = text(a), text(b)
    assert left and left == right


def test_large_keys_are_found(readings):
    assert {r.sensor_id for r in hot_keys(readings, "sensor_id", LIMIT).collect()} >= {0, 1, 2, 3}
    assert hot_keys(readings, "sensor_id", 10_000) is None


def _brute_trailing(rows, closed):
    result = {}
    for event, sensor, t, _ in rows:
        x = [v for _, s, u, v in rows if s == sensor and u <= t and (u >= t - SIZE if closed else u > t - SIZE)]
        result[event] = (float(np.mean(x)), len(x))
    return result


@pytest.mark.parametrize("limit", [LIMIT, 5, 10_000])
def test_trailing_means(readings, rows, limit):
    expected = _brute_trailing(rows, closed=True)
    actual = {r.event_id: (r.average, r.n_average) for r in sensor_trailing_means(readings, SIZE, limit).collect()}
    assert actual.keys() == expected.keys()
    for event, (mean, n) in expected.items():
        assert actual[event][1] == n
        assert np.isclose(actual[event][0], mean, equal_nan=True)


def test_motor_trailing_means(readings, rows):
    expected = _brute_trailing(rows, closed=False)
    actual = {r.event_id: r for r in motor_trailing_means(readings, SIZE, LIMIT).collect()}
    for event, sensor, _, _ in rows:
        name = ("air", "process", "speed", "torque")[sensor & 3]
        mean, n = expected[event]
        assert actual[event][f"n_{name}"] == n
        assert np.isclose(actual[event][name], mean, equal_nan=True)
    same(motor_trailing_means(readings, SIZE, LIMIT), motor_trailing_means(readings, SIZE))


def test_latest_values(readings):
    values = {"value": F.col("reading")}
    same(latest_values(readings, values, LIMIT), latest_values(readings, values))


def test_liveness(readings, rows):
    gap = 40 * SECOND_US
    expected = {}
    for sensor in {r[1] for r in rows}:
        times = sorted(r[2] for r in rows if r[1] == sensor)
        kept = next((i for i in range(1, len(times)) if times[i] - times[i - 1] > gap), len(times))
        expected[sensor] = (kept, len(times) - kept, times[kept - 1])
    for limit in (LIMIT, 7, 10_000):
        actual = {r.sensor_id: (r.kept, r.dropped, r.cut_us) for r in sensor_liveness(readings, gap, limit).collect()}
        assert actual == expected


def test_liveness_gap_edge(spark):
    """A gap of exactly the limit is no silence."""
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 11), (1, 12)], "sensor_id long, ts_us long")
    report = sensor_liveness(df, 5).first()
    assert (report.kept, report.dropped, report.cut_us) == (2, 2, 5)


def test_throttled_averages(readings):
    same(
        resets.throttled_averages(readings, SIZE, INTERVAL, START, LIMIT),
        resets.throttled_averages(readings, SIZE, INTERVAL, START),
    )


@pytest.mark.parametrize("size", [5, 20, 50, 64, 100])
def test_throttled_ranges(readings, rows, size):
    """Ranges shorter and longer than the interval, whole multiples of it or not."""
    size *= SECOND_US
    finite = readings.where(~F.isnan("reading"))
    rows = [r for r in rows if r[3] == r[3]]
    reports = resets.throttled_averages(finite, size, INTERVAL, START, LIMIT).collect()
    last = {}
    for r in sorted(reports, key=lambda r: (r.sensor_id, r.ts_us)):
        due = last.get(r.sensor_id, START) + INTERVAL
        assert r.ts_us == min(t for _, s, t, _ in rows if s == r.sensor_id and t >= due)
        last[r.sensor_id] = r.ts_us
        x = [v for _, s, t, v in rows if s == r.sensor_id and r.ts_us - size <= t <= r.ts_us]
        assert (r.n, r.average) == (len(x), pytest.approx(np.mean(x)))
    for sensor in {r[1] for r in rows}:
        assert not [t for _, s, t, _ in rows if s == sensor and t >= last.get(sensor, START) + INTERVAL]


def test_alerts_latest_reset(readings):
    averages = resets.throttled_averages(readings, SIZE, INTERVAL, START).select(
        F.shiftright("sensor_id", 2).alias("motor_id"),
        F.col("sensor_id").bitwiseAND(F.lit(3).cast("bigint")).alias("channel"), "ts_us", "average", "n",
    )
    same(resets.alerts_latest_reset(averages, START, rows_per_task=10), resets.alerts_latest_reset(averages, START))


def _brute_trailing_reset(rows, unit):
    """The definition, reading by reading."""
    from driftwatch.functions.rules import ThresholdRule, first_failure_array

    alerts = []
    for motor in sorted({r[1] >> 2 for r in rows}):
        buffers, since = {k: [] for k in range(4)}, START
        for _, sensor, t, x in sorted((r for r in rows if r[1] >> 2 == motor), key=lambda r: (r[2], r[1])):
            buffers[sensor & 3].append((t, x))
            for k in range(4):
                buffers[k] = [(u, v) for u, v in buffers[k] if u > t - SIZE]
            if all(buffers.values()):
                air, process, speed, torque = (np.array([np.mean([v for _, v in buffers[k]])]) for k in range(4))
                power = torque * (speed / 60 * np.pi * 2)
                strain = (t - since) / unit * torque
                failure = first_failure_array(ThresholdRule().conditions(air - process, speed, power, strain, np))[0]
                if failure:
                    alerts.append((motor, t, str(failure)))
                    buffers, since = {k: [] for k in range(4)}, t
    return sorted(alerts)


@pytest.mark.parametrize("limit", [LIMIT, 10_000])
def test_alerts_trailing_reset(readings, rows, limit):
    alerts = resets.alerts_trailing_reset(readings, SIZE, START, SECOND_US, rows_per_task=limit)
    actual = sorted((r.motor_id, r.t, r.failure) for r in alerts.withColumn("t", F.unix_micros("ts")).collect())
    expected = _brute_trailing_reset(rows, SECOND_US)
    assert {a[2] for a in expected} >= {"PowerFailure", "OverstrainFailure"}
    assert actual == expected


def test_alerts_age_strain(readings):
    size = 8 * SECOND_US
    same(
        resets.alerts_age_strain(readings, size, START, rows_per_task=10),
        resets.alerts_age_strain(readings, size, START),
    )


def test_scan_keeps_chunks_together(spark, readings):
    """Adaptive planning must not spread a chunk over tasks, neither by local reads nor by reusing a join's layout."""
    expected = resets.alerts_trailing_reset(readings, SIZE, START, SECOND_US)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = resets.alerts_trailing_reset(readings.repartition(8), SIZE, START, SECOND_US, rows_per_task=LIMIT)
        same(spread, expected)
        # Already laid out by the scan's own keys.
        laid_out = readings.join(readings.select("motor_id").distinct(), "motor_id")
        same(resets.alerts_trailing_reset(laid_out, SIZE, START, SECOND_US), expected)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches(spark, readings):
    """A key that spans many Arrow batches gives the same picks."""
    expected = resets.alerts_trailing_reset(readings, SIZE, START, SECOND_US).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        actual = resets.alerts_trailing_reset(readings, SIZE, START, SECOND_US).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, actual)) == sorted(map(tuple, expected))


@pytest.mark.parametrize("limit", [0, 300, 10_000])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(3)
    samples = {
        1: np.round(rng.lognormal(0, 3, 999), 3), 2: np.array([4.0]), 3: np.full(50, 2.5),
        4: np.concatenate([rng.normal(0, 1e-9, 500), [1e12]]), 5: np.array([1.0, 2.0]), 6: -rng.integers(0, 5, 301) * 1.0,
    }
    df = spark.createDataFrame([(k, float(v)) for k, values in samples.items() for v in values], "k long, v double")
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    result = {r.k: r for r in exact_quantiles(df, ["k"], "v", p, limit).collect()}
    for k, values in samples.items():
        assert result[k].n == len(values)
        assert np.allclose(result[k].q, np.quantile(values, p), rtol=1e-12, atol=1e-18)


def test_summary_of_a_group_without_samples(spark):
    samples = spark.createDataFrame([(1, 5.0)], "k long, value double")
    groups = spark.createDataFrame([(1,), (2,)], "k long")
    summary = {r.k: tuple(r)[1:] for r in five_number_summary(samples, ["k"], groups=groups).collect()}
    assert summary == {1: (5.0,) * 5, 2: (0.0,) * 5}


def test_numbered_runs(spark, monkeypatch):
    monkeypatch.setattr("driftwatch.operators.comparison.RUNS_PER_BLOCK", 10)
    df = spark.range(200).withColumn("event_id", F.col("id") * 3).withColumn("k", F.pmod("id", F.lit(3)))
    numbers = number_runs(df, ["k"]).orderBy("k", "event_id").collect()
    assert numbers == number_runs(df, ["k"]).orderBy("k", "event_id").collect()
    for k in range(3):
        assert [r.run_no for r in numbers if r.k == k] == list(range(1, sum(r.k == k for r in numbers) + 1))
