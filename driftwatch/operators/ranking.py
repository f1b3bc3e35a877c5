"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: str, block: Column, name: str) -> DataFrame:
    """`row_number` per `keys` in the order of `block`, and inside a block of the column `order`, unique there.

    Rows are numbered inside their block and shifted by the rows of the blocks before it, so no group is sorted in one
    task. Choose blocks that hold a bounded number of rows, such as ranges of an identifier or the blocks of a file.
    """
    blocked = rows.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows")).select(
        *[F.col(key).alias(f"_key_{i}") for i, key in enumerate(keys)], F.col("_block").alias("_at"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    same = F.col("_block").eqNullSafe(F.col("_at"))
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, same)
        .select(*rows.columns, (F.col("_offset") + F.col("_inside")).alias(name))
    )
