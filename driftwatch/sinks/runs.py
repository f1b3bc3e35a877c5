"""Measured runs and their summaries as partitioned CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.operators.quantiles import SUMMARY
from driftwatch.sources.runs import PARAMETERS


def _append(rows: DataFrame, folder: str, keys: list[str], append_id: str | None) -> None:
    """Append rows below one folder per key. With an `append_id`, a repeat of that append takes its place.

    Each append then has a folder of its own below each key, `append_id=...`, which a repeat overwrites as a whole when it commits.
    So an append that failed, or whose answer was lost, can be made again without doubling rows.
    """
    if append_id is None:
        rows.write.mode("append").partitionBy(*keys).option("header", True).csv(folder)
        return
    writer = rows.withColumn("append_id", F.lit(append_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys, "append_id").option("header", True).csv(folder)


def append_runs(runs: DataFrame, folder: str, append_id: str | None = None) -> None:
    """Append run rows below one folder per parameter set and model; many runs of one set are shared by several tasks."""
    keys = [*PARAMETERS, "model"]
    _append(runs.hint("rebalance", *keys), folder, keys, append_id)


def write_summary(summary: DataFrame, folder: str, append_id: str | None = None) -> None:
    """Append five-number summaries below one folder per metric, outer axes and model."""
    keys = ["metric", "y_outer", "x_outer", "model"]
    columns = [*keys, "x_inner", *SUMMARY]
    ordered = summary.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "x_inner")
    _append(ordered, folder, keys, append_id)


def append_delay_series(alerts: DataFrame, folder: str) -> None:
    """Append the delays of alerts in the form `delay_series_files` reads, one number per line.

    A line may hold any number of delays; one each keeps long series from meeting in one task.
    """
    alerts.select(F.concat(F.col("delay").cast("string"), F.lit(",")).alias("value")).write.mode("append").text(folder)
