"""Finding the keys that are too large for one task, and cutting their time line.

Ordered work per key needs the key's rows in one place. Most keys are small; a few may hold a large share
of all rows. One aggregation over the key and time columns finds those, and only they are cut into time
chunks of about `rows_per_task` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000

# Large keys brought to the driver and broadcast; a row is the key and a few numbers.
MAX_BROADCAST_KEYS = 100_000


def large_groups(rows: DataFrame, keys: list[str], rows_per_task: int, **measures: Column) -> DataFrame | None:
    """Groups with more than `rows_per_task` rows: keys, `rows` and `measures`; None if there are none.

    This runs one job. Up to `MAX_BROADCAST_KEYS` groups come back as a broadcast table; beyond that the
    aggregation itself is returned, and the planner chooses how to join it.
    """
    aggregates = [F.count(F.lit(1)).alias("rows"), *[measure.alias(name) for name, measure in measures.items()]]
    large = rows.groupBy(*keys).agg(*aggregates).where(F.col("rows") > rows_per_task)
    found = large.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > MAX_BROADCAST_KEYS:
        return large
    return F.broadcast(rows.sparkSession.createDataFrame(found, large.schema))


def hot_keys(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Large keys with their time span: key, `rows`, `first_us`, `last_us`."""
    return large_groups(rows, [key], rows_per_task, first_us=F.min("ts_us"), last_us=F.max("ts_us"))


def whole_rows(rows: DataFrame, lookback_us: int | None = None) -> DataFrame:
    """Rows whose key is a single chunk."""
    whole = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    return whole if lookback_us is None else whole.withColumn("fresh", F.lit(True))


def cut_rows(rows: DataFrame, key: str, hot: DataFrame, rows_per_task: int, lookback_us: int | None = None,
             how: str = "inner") -> DataFrame:
    """Add `chunk`, a number that grows with time inside a key of `hot`.

    With how="left", rows of other keys stay, in chunk 0. With `lookback_us`, rows are also copied to the
    later chunk that looks back at them; `fresh` tells a row in its own chunk from a copy. Chunks are
    never shorter than the look-back, so a row has at most one copy.
    """
    # The span divided by the number of chunks wanted, in whole microseconds.
    span = F.col("last_us") - F.col("first_us") + F.lit(1)
    parts = F.ceil(F.col("rows") / F.lit(float(rows_per_task)))
    width = F.greatest(F.ceil(span / parts), F.lit(max(lookback_us or 0, 1)).cast("bigint"))
    cuts = hot.select(key, F.col("first_us").alias("_origin"), F.col("last_us").alias("_last"), width.alias("_width"))

    def chunk_at(micros: Column) -> Column:
        number = F.call_function("div", micros - F.col("_origin"), F.col("_width"))
        return F.coalesce(number, F.lit(0).cast("bigint"))

    placed = rows.join(cuts, key, how).withColumn("chunk", chunk_at(F.col("ts_us")))
    if lookback_us is None:
        return placed.drop("_origin", "_last", "_width")
    seen_until = chunk_at(F.least(F.col("ts_us") + F.lit(lookback_us), F.col("_last")))
    copies = placed.withColumn("_own", F.col("chunk")).withColumn("chunk", F.explode(F.sequence("_own", seen_until)))
    return copies.withColumn("fresh", F.col("chunk") == F.col("_own")).drop("_own", "_origin", "_last", "_width")


def with_chunks(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, bool]:
    """Add `chunk` to all rows and say whether any key was cut."""
    hot = hot_keys(rows, key, rows_per_task)
    if hot is None:
        return whole_rows(rows), False
    return cut_rows(rows, key, hot, rows_per_task, how="left"), True
