"""Event-time window averages per sensor and per motor.

The grouped forms need one shuffle on the group key, and the map side already folds each
(window, key) to a few numbers, so a hot sensor costs one row per task and window in the shuffle.
They accept streams: call `withWatermark` first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.channels import all_present, per_channel, position
from driftwatch.functions.rules import (
    ConfidenceRule,
    ThresholdRule,
    confidence_failure,
    mean_count,
    threshold_failure,
)
from driftwatch.functions.timegrid import bucket_number, epoch_seconds, window_length
from driftwatch.schemas import CHANNELS

COUNTS = tuple(f"n_{name}" for name in CHANNELS)


def time_window(size_us: int, slide_us: int | None = None) -> Column:
    """Epoch-aligned half-open windows; tumbling unless a slide is given."""
    return F.window("ts", window_length(size_us), window_length(slide_us or size_us))


def sensor_windows(readings: DataFrame, size_us: int, slide_us: int | None = None) -> DataFrame:
    """Mean, count and latest time per sensor and window."""
    return readings.groupBy(time_window(size_us, slide_us), "sensor_id").agg(
        F.avg("reading").alias("average"), F.count("reading").alias("n"), F.max("ts").alias("max_ts")
    )


def sensor_sliding_windows(readings: DataFrame, size_us: int, slide_us: int) -> DataFrame:
    """Batch form of the sliding window average.

    Readings are folded into panes of width gcd(size, slide) before they are copied into the windows
    that overlap, so the copying touches pane rows rather than readings. Streams use `sensor_windows`.
    """
    pane_us = math.gcd(size_us, slide_us)
    panes = readings.groupBy("sensor_id", bucket_number(F.col("ts_us"), pane_us).alias("pane")).agg(
        F.sum("reading").alias("total"), F.count("reading").alias("n"), F.max("ts").alias("max_ts")
    )
    last = bucket_number(F.col("pane") * F.lit(pane_us), slide_us)
    # The first slide step whose window still covers this pane.
    first = bucket_number(F.col("pane") * F.lit(pane_us) - F.lit(size_us), slide_us) + F.lit(1)
    spread = panes.where(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    start = F.timestamp_micros(F.col("step") * F.lit(slide_us))
    end = F.timestamp_micros(F.col("step") * F.lit(slide_us) + F.lit(size_us))
    return (
        spread.groupBy("sensor_id", "step")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("max_ts").alias("max_ts"))
        .where(F.col("n") > 0)
        .select(
            F.struct(start.alias("start"), end.alias("end")).alias("window"),
            "sensor_id",
            (F.col("total") / F.col("n")).alias("average"),
            "n",
            "max_ts",
        )
    )


def motor_windows(readings: DataFrame, size_us: int, slide_us: int | None = None) -> DataFrame:
    """Four channel averages and counts per motor and window, in a single aggregation.

    Averaging per sensor and then collecting the four averages per motor gives the same numbers,
    because a channel of a motor is one sensor; folding both steps saves a shuffle.
    """
    totals, counts = [], []
    for name, value in per_channel(F.col("reading")).items():
        totals.append(F.sum(value).alias(f"total_{name}"))
        counts.append(F.count(value).alias(f"n_{name}"))
    grouped = readings.groupBy(time_window(size_us, slide_us), "motor_id").agg(
        *totals, *counts, F.max("ts").alias("max_ts")
    )
    averages = [
        (F.col(f"total_{name}") / F.nullif(F.col(f"n_{name}"), F.lit(0))).alias(name) for name in CHANNELS
    ]
    return grouped.select("window", "motor_id", *averages, *COUNTS, "max_ts")


def complete(motors: DataFrame) -> DataFrame:
    """Keep motors for which all four channels reported."""
    return motors.where(all_present()).withColumn("mean_n", mean_count([F.col(c) for c in COUNTS]))


def confidence_alerts(motors: DataFrame, rule: ConfidenceRule = ConfidenceRule()) -> DataFrame:
    """Alerts of the confidence-interval rule; the alert time is the latest reading of the window."""
    failure = confidence_failure(*[F.col(c) for c in CHANNELS], F.col("mean_n"), rule)
    return (
        complete(motors)
        .withColumn("failure", failure)
        .where(F.col("failure").isNotNull())
        .select("motor_id", "window", F.col("max_ts").alias("ts"), "failure")
    )


def threshold_alerts(motors: DataFrame, start_us: int, age_unit_us: int,
                     rule: ThresholdRule = ThresholdRule()) -> DataFrame:
    """Alerts of the threshold rule, with the age counted from the run start to the window end."""
    age = (F.unix_micros("window.end") - F.lit(start_us)) / F.lit(float(age_unit_us))
    failure = threshold_failure(*[F.col(c) for c in CHANNELS], age, rule)
    return (
        complete(motors)
        .withColumn("failure", failure)
        .where(F.col("failure").isNotNull())
        .select("motor_id", "window", F.col("max_ts").alias("ts"), "failure")
    )


def window_sweep(readings: DataFrame, sizes_us: list[int], rule: ConfidenceRule = ConfidenceRule()) -> DataFrame:
    """The confidence rule for several tumbling window sizes at once.

    One scan folds the readings into windows of the sizes' greatest common divisor; the sizes are then
    expanded over those few rows. Batch only.
    """
    base_us = math.gcd(*sizes_us)
    aggregates = []
    for name, value in per_channel(F.col("reading")).items():
        aggregates += [F.sum(value).alias(f"total_{name}"), F.count(value).alias(f"n_{name}")]
    base = readings.groupBy("motor_id", bucket_number(F.col("ts_us"), base_us).alias("base")).agg(
        *aggregates, F.max("ts").alias("max_ts")
    )
    ratios = F.array(*[F.lit(size // base_us).cast("bigint") for size in sizes_us])
    expanded = base.withColumn("ratio", F.explode(ratios))
    slot = F.call_function("div", F.col("base") - F.pmod("base", "ratio"), F.col("ratio"))
    merged = expanded.groupBy("ratio", slot.alias("slot"), "motor_id").agg(
        *[F.sum(f"total_{name}").alias(f"total_{name}") for name in CHANNELS],
        *[F.sum(count).alias(count) for count in COUNTS],
        F.max("max_ts").alias("max_ts"),
    )
    size = F.col("ratio") * F.lit(base_us)
    start = F.timestamp_micros(F.col("slot") * size)
    end = F.timestamp_micros((F.col("slot") + F.lit(1)) * size)
    motors = merged.select(
        size.alias("size_us"),
        F.struct(start.alias("start"), end.alias("end")).alias("window"),
        "motor_id",
        *[(F.col(f"total_{name}") / F.nullif(F.col(f"n_{name}"), F.lit(0))).alias(name) for name in CHANNELS],
        *COUNTS,
        "max_ts",
    )
    failure = confidence_failure(*[F.col(c) for c in CHANNELS], F.col("mean_n"), rule)
    return (
        complete(motors)
        .withColumn("failure", failure)
        .where(F.col("failure").isNotNull())
        .select("size_us", "motor_id", "window", F.col("max_ts").alias("ts"), "failure")
    )


def sweep_grid(spark, windows_us: list[int], slides_us: list[int], sensor_us: list[int]) -> DataFrame:
    """Every parameter combination whose sensor interval and slide both fit into the window."""
    def column(values, name):
        return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])).alias(name))

    grid = (
        column(windows_us, "window_us")
        .join(column(slides_us, "slide_us"), F.col("slide_us") <= F.col("window_us"))
        .join(column(sensor_us, "sensor_us"), F.col("sensor_us") <= F.col("window_us"))
    )
    return grid


def with_delay(alerts: DataFrame) -> DataFrame:
    """Seconds from the alert's latest reading to the moment its window could be evaluated."""
    micros = F.unix_micros("window.end") - F.unix_micros("ts")
    return alerts.withColumn("delay", epoch_seconds(micros))


def first_per_bucket(rows: DataFrame, key: str, bucket: Column, name: str, keep: str = "event_id") -> DataFrame:
    """Drop rows whose bucket equals the previous row's, for rows read in (time, sensor) order.

    Rows of one bucket are neighbours in time order, so the survivors are the earliest row of each
    bucket: an aggregation, where comparing neighbours would sort each key in one task.
    """
    first = F.min_by(F.col(keep), position(F.col("ts_us"), F.col("channel")))
    return rows.groupBy(key, bucket.alias(name)).agg(first.alias(keep))


def run_bounds(rows: DataFrame, start_us: int, duration_us: int) -> DataFrame:
    """Rows inside [start, start + duration).

    The bounds are cast to the type of `ts`, never the other way round, so the filter reaches the scan
    of tables that store timestamps without zone.
    """
    kind = rows.schema["ts"].dataType
    start = F.timestamp_micros(F.lit(start_us)).cast(kind)
    end = F.timestamp_micros(F.lit(start_us + duration_us)).cast(kind)
    return rows.where((F.col("ts") >= start) & (F.col("ts") < end))
