"""Cutting a sensor off at its first long silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators.splitting import ROWS_PER_TASK, with_chunks


def sensor_liveness(readings: DataFrame, gap_us: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per sensor: readings kept, readings dropped and the time of the last reading kept.

    Readings after the first gap longer than `gap_us` are dropped for good. A sensor with many readings
    is cut into chunks; each is reduced to its edges, its size and its first gap, and only those rows
    meet per sensor. Batch only.
    """
    chunks, _ = with_chunks(readings.select("sensor_id", "ts_us"), "sensor_id", rows_per_task)
    order = Window.partitionBy("sensor_id", "chunk").orderBy("ts_us")
    gap_after = F.lead("ts_us").over(order) - F.col("ts_us") > F.lit(gap_us)
    # The last reading before a gap, and how many readings of the chunk come up to it.
    marked = chunks.select(
        "sensor_id",
        "chunk",
        "ts_us",
        F.when(gap_after, F.col("ts_us")).alias("gap_ts"),
        F.when(gap_after, F.row_number().over(order)).alias("gap_rows"),
    )
    edges = marked.groupBy("sensor_id", "chunk").agg(
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
        F.count(F.lit(1)).alias("n"),
        F.min("gap_ts").alias("gap_ts"),
        F.min("gap_rows").cast("bigint").alias("gap_rows"),
    )
    by_chunk = Window.partitionBy("sensor_id").orderBy("chunk")
    silent_after = F.lead("first_ts").over(by_chunk) - F.col("last_ts") > F.lit(gap_us)
    cut = edges.select(
        "*",
        F.when(F.col("gap_ts").isNotNull(), F.col("gap_ts")).when(silent_after, F.col("last_ts")).alias("cut_ts"),
        F.when(F.col("gap_ts").isNotNull(), F.col("gap_rows")).otherwise(F.col("n")).alias("kept_rows"),
    )
    cuts_before = F.count("cut_ts").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1))
    kept = F.when(F.col("cuts_before") == 0, F.col("kept_rows")).otherwise(F.lit(0))
    return (
        cut.withColumn("cuts_before", cuts_before)
        .groupBy("sensor_id")
        .agg(
            F.sum(kept).alias("kept"),
            (F.sum("n") - F.sum(kept)).alias("dropped"),
            F.coalesce(F.min("cut_ts"), F.max("last_ts")).alias("cut_us"),
        )
    )


def live_readings(readings: DataFrame, gap_us: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The readings a monitor would have accepted."""
    cuts = sensor_liveness(readings, gap_us, rows_per_task).select("sensor_id", "cut_us")
    return readings.join(cuts, "sensor_id").where(F.col("ts_us") <= F.col("cut_us")).drop("cut_us")
