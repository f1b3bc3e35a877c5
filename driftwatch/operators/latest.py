"""The last known value of every channel at each update of a motor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.channels import position
from driftwatch.operators.splitting import ROWS_PER_TASK, with_chunks
from driftwatch.schemas import CHANNELS


def latest_values(rows: DataFrame, values: dict[str, Column], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """For each entry of `values`, add one column per channel, `<name>_<channel>`.

    Rows need `motor_id`, `channel` and `ts_us`. A channel not seen yet is null. A motor with many rows
    is cut into chunks; each looks up what was known at its start in a table of one row per chunk.
    Batch only.
    """
    original = rows.columns
    chunked, cut = with_chunks(rows, "motor_id", rows_per_task)
    keyed = chunked.select(
        *original,
        "chunk",
        position(F.col("ts_us"), F.col("channel")).alias("_pos"),
        *[value.alias(f"_v_{name}") for name, value in values.items()],
    )
    slots = [(f"{name}_{channel}", F.when(F.col("channel") == k, F.col(f"_v_{name}")))
             for name in values for k, channel in enumerate(CHANNELS)]
    so_far = Window.partitionBy("motor_id", "chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.select(
        *original, "chunk", *[F.last(value, ignorenulls=True).over(so_far).alias(slot) for slot, value in slots]
    )
    if not cut:
        return inside.drop("chunk")

    at_end = keyed.groupBy("motor_id", "chunk").agg(
        *[F.max_by(value, F.when(value.isNotNull(), F.col("_pos"))).alias(slot) for slot, value in slots]
    )
    earlier = Window.partitionBy("motor_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    at_start = at_end.select(
        "motor_id",
        "chunk",
        *[F.last(slot, ignorenulls=True).over(earlier).alias(f"_start_{slot}") for slot, _ in slots],
    )
    return inside.join(at_start, ["motor_id", "chunk"]).select(
        *original, *[F.coalesce(slot, f"_start_{slot}").alias(slot) for slot, _ in slots]
    )
