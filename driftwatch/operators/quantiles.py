"""Exact quantiles per group, for groups of any size.

The built-in exact percentile keeps a group's distinct values in one task, which suits ordinary groups.
For large ones the wanted ranks are found by radix selection: doubles map to 64-bit numbers of the same order, and four passes
settle sixteen bits each. A pass counts the values that agree with a wanted rank so far by their next sixteen bits; tasks
fold their rows into such counts, so what meets per group and rank is a table of at most 65,536 counts, however the
values lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from driftwatch.operators.splitting import MAX_BROADCAST_KEYS, ROWS_PER_TASK, large_groups
from driftwatch.session import ensure_checkpoint_dir

DIGIT_BITS = 16
WORD_BITS = 64
ALL_BUT_SIGN = (1 << 63) - 1


@arrow_udf(T.LongType())
def image_of(values: pa.Array) -> pa.Array:
    """Whole numbers in the order of doubles: minus infinity first, then numbers, infinity, NaN. Zeros are equal."""
    bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & ALL_BUT_SIGN))


@arrow_udf(T.DoubleType())
def value_of(images: pa.Array) -> pa.Array:
    bits = images.to_numpy(zero_copy_only=False)
    return pa.array((bits ^ ((bits >> 63) & ALL_BUT_SIGN)).view(np.float64))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose count proves it small."""
    return F.broadcast(table) if table.count() <= rows else table


def selected(images: DataFrame, keys: list[str], wanted: DataFrame, broadcast_rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """The numbers of given ranks: keys, `slot` and `image`.

    images: keys and `image`. wanted: keys, `slot` and `rank`, from 0 on among the group's numbers in order.
    """
    digit_range = (1 << DIGIT_BITS) - 1
    found = wanted.withColumn("prefix", F.lit(0).cast("bigint")).checkpoint()
    for shift in range(WORD_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        top = shift == WORD_BITS - DIGIT_BITS
        above = F.lit(0).cast("bigint") if top else F.shiftright("image", shift + DIGIT_BITS)
        # The top digit has the sign; the others count from 0.
        digit = F.shiftright("image", shift) if top else F.shiftright("image", shift).bitwiseAND(F.lit(digit_range).cast("bigint"))
        sought = _small(found.select(*keys, "prefix").distinct(), broadcast_rows)
        counts = (images.select(*keys, above.alias("prefix"), digit.alias("digit")).join(sought, [*keys, "prefix"])
                  .groupBy(*keys, "prefix", "digit").agg(F.count(F.lit(1)).alias("rows")))
        order = Window.partitionBy(*keys, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("end", F.sum("rows").over(order))
        inside = (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("rows"))
        prefix = F.col("digit") if top else F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit"))
        found = placed.join(_small(found, broadcast_rows), [*keys, "prefix"]).where(inside).select(
            *keys, "slot", (F.col("rank") - F.col("end") + F.col("rows")).alias("rank"), prefix.alias("prefix")).checkpoint()
    return found.select(*keys, "slot", F.col("prefix").alias("image"))


def radix_quantiles(rows: DataFrame, groups: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Quantiles of `_x` for the listed groups, which carry their number of `rows`: keys, `n`, `q`."""
    ensure_checkpoint_dir(rows.sparkSession)
    points = [(F.col("rows") - F.lit(1)) * F.lit(float(p)) for p in probabilities]
    ranks = F.array(*[edge(point).cast("bigint") for point in points for edge in (F.floor, F.ceil)])
    images = rows.join(groups.select(*keys), keys).select(*keys, image_of("_x").alias("image")).checkpoint()
    wanted = groups.select(*keys, F.posexplode(ranks).alias("slot", "rank"))
    found = selected(images, keys, wanted).withColumn("_x", value_of("image"))
    slots = range(2 * len(probabilities))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == s, F.col("_x"))).alias(f"_x{s}") for s in slots])
    quantiles = []
    for i, point in enumerate(points):
        lower, upper = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        # As the built-in percentile does it, also where a value is infinite.
        between = (F.ceil(point) - point) * lower + (point - F.floor(point)) * upper
        quantiles.append(F.when(lower == upper, lower).otherwise(between))
    return found.join(groups, keys).select(*keys, F.col("rows").alias("n"), F.array(*quantiles).alias("q"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float],
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per group: the keys, `n`, and `q`, an array of linearly interpolated quantiles.

    Null values are ignored.
    """
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    large = large_groups(values, keys, rows_per_task)

    def builtin(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.percentile("_x", [float(p) for p in probabilities]).alias("q")
        )

    if large is None:
        return builtin(values)
    small = builtin(values.join(large, keys, "left_anti"))
    return small.unionByName(radix_quantiles(values, large, keys, probabilities))


SUMMARY = ("lower_fence", "lower_quartile", "median", "upper_quartile", "upper_fence")


def five_number_summary(samples: DataFrame, keys: list[str], value: str = "value",
                        groups: DataFrame | None = None) -> DataFrame:
    """Quartiles with fences 1.5 interquartile ranges beyond them.

    `groups` lists groups that must appear; those without a sample are reported as zeros.
    """
    q = exact_quantiles(samples, keys, value, [0.25, 0.5, 0.75])
    low, mid, high = (F.col("q")[i] for i in range(3))
    spread = (high - low) * 1.5
    columns = [low - spread, low, mid, high, high + spread]
    summary = q.select(*keys, *[c.alias(name) for c, name in zip(columns, SUMMARY)])
    if groups is None:
        return summary
    listed = groups.select(*keys).distinct().join(summary, keys, "left")
    return listed.select(*keys, *[F.coalesce(name, F.lit(0.0)).alias(name) for name in SUMMARY])
