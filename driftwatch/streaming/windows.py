"""Streaming forms of the window operators.

Windows close when the watermark passes their end, so results are final and written in append mode.
`lateness` is how far behind the newest reading a late one may be; later ones are dropped. State is
bounded by the open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.rules import ConfidenceRule
from driftwatch.functions.timegrid import window_length
from driftwatch.operators import joins, windows


def watermarked(readings: DataFrame, lateness_us: int = 0) -> DataFrame:
    return readings.withWatermark("ts", window_length(lateness_us))


def sensor_averages(readings: DataFrame, size_us: int, slide_us: int | None = None, lateness_us: int = 0) -> DataFrame:
    return windows.sensor_windows(watermarked(readings, lateness_us), size_us, slide_us)


def confidence_alerts(readings: DataFrame, size_us: int, slide_us: int | None = None, lateness_us: int = 0,
                      rule: ConfidenceRule = ConfidenceRule()) -> DataFrame:
    """The monitoring query end to end: window, average, assemble, test. One stateful operator."""
    motors = windows.motor_windows(watermarked(readings, lateness_us), size_us, slide_us)
    return windows.confidence_alerts(motors, rule)


def temperature_difference(readings: DataFrame, size_us: int, lateness_us: int = 0) -> DataFrame:
    """Left join of two windowed streams; an unmatched window is written once it can no longer match."""
    return joins.temperature_difference(watermarked(readings, lateness_us), size_us)


def speed_torque(readings: DataFrame, size_us: int, lateness_us: int = 0) -> DataFrame:
    return joins.speed_torque(watermarked(readings, lateness_us), size_us)


def motor_records(readings: DataFrame, size_us: int, lateness_us: int = 0) -> DataFrame:
    return joins.motor_records(watermarked(readings, lateness_us), size_us)


def motor_records_joined(readings: DataFrame, size_us: int, lateness_us: int = 0) -> DataFrame:
    """The same rows from three stream-stream left joins over four windowed streams."""
    return joins.motor_records_joined(watermarked(readings, lateness_us), size_us)


def deduplicated(records: DataFrame, lateness_us: int = 0) -> DataFrame:
    """One record per motor and time. Drops every repeat within the watermark, neighbouring or not."""
    return watermarked(records, lateness_us).dropDuplicatesWithinWatermark(["motor_id", "ts"])


def live_sessions(readings: DataFrame, gap_us: int, lateness_us: int = 0) -> DataFrame:
    """Uninterrupted stretches per sensor; the first one is what a cut-off monitor would have seen."""
    return (
        watermarked(readings, lateness_us)
        .groupBy(F.session_window("ts", window_length(gap_us)).alias("session"), "sensor_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
