"""Means over a trailing time range, one result per reading.

A range frame over a sensor would sort the whole sensor in one task and re-add every reading of the
range for every row. Here time is cut into panes of size / k. The range that ends at a reading consists of

- the head: readings of its own pane up to the reading,
- the middle: the k - 1 full panes before it,
- the tail: readings at the end of the pane k steps back.

Each reading is also sent k panes ahead as an echo, moved forward by the size, so head and tail are
running sums inside one (key, pane) partition. Ordinary keys use k = 1; keys with many readings per range
get more panes, so their work spreads out. The work is linear up to the sort, and no running sum is ever
subtracted, so a NaN leaves the mean once it leaves the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.channels import per_channel
from driftwatch.operators.splitting import ROWS_PER_TASK, hot_keys


def _plus(*parts: Column) -> Column:
    total = F.coalesce(parts[0], F.lit(0))
    for part in parts[1:]:
        total = total + F.coalesce(part, F.lit(0))
    return total


def _pane_widths(rows: DataFrame, key: str, size_us: int, rows_per_task: int) -> DataFrame | None:
    """Pane width of the keys that need more than one pane: the size halved until a pane is small enough."""
    hot = hot_keys(rows.select(key, "ts_us"), key, rows_per_task)
    if hot is None:
        return None
    span = F.greatest(F.col("last_us") - F.col("first_us"), F.lit(1))
    per_range = F.col("rows") * F.least(F.lit(size_us) / span, F.lit(1.0))
    halvings = F.greatest(F.ceil(F.log2(per_range / F.lit(float(rows_per_task)))), F.lit(0))
    # Panes must divide the size evenly, which allows as many halvings as the size has factors of two.
    most = (size_us & -size_us).bit_length() - 1
    panes = F.pow(F.lit(2.0), F.least(halvings, F.lit(most))).cast("bigint")
    return hot.select(key, F.call_function("div", F.lit(size_us), panes).alias("_width"))


def trailing_means(rows: DataFrame, key: str, values: dict[str, Column], size_us: int, *,
                   closed: bool, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `<name>` (mean, null when the range holds none) and `n_<name>` for every entry of `values`.

    `closed` keeps readings exactly `size_us` old; otherwise they have left the range. Readings with
    equal time see each other. Batch only: a stream would need keyed state.
    """
    original = rows.columns
    values = {name: value.cast("double") for name, value in values.items()}
    size = F.lit(size_us).cast("bigint")
    widths = _pane_widths(rows, key, size_us, rows_per_task)
    if widths is None:
        sized = rows.withColumn("_width", size)
    else:
        sized = rows.join(widths, key, "left").withColumn("_width", F.coalesce("_width", size))
    base = sized.withColumn("_pane", F.col("ts_us") - F.pmod("ts_us", "_width")).drop("_width")

    # One scan feeds both copies. The doubled clock leaves odd numbers free for the open lower edge.
    # The shuffle carries plain rows; everything else is derived behind it.
    echo = F.col("_echo")
    copies = base.withColumn("_echo", F.explode(F.array(F.lit(False), F.lit(True))))
    copies = copies.withColumn("_pane", F.when(echo, F.col("_pane") + size).otherwise(F.col("_pane")))
    copies = copies.repartition(key, "_pane")
    echo_clock = (F.col("ts_us") + size) * F.lit(2) - F.lit(0 if closed else 1)
    copies = copies.withColumn("_clock", F.when(echo, echo_clock).otherwise(F.col("ts_us") * F.lit(2)))
    in_pane = Window.partitionBy(key, "_pane")
    upto = in_pane.orderBy("_clock").rangeBetween(Window.unboundedPreceding, 0)
    since = in_pane.orderBy(F.desc("_clock")).rangeBetween(Window.unboundedPreceding, 0)
    running = []
    for name, value in values.items():
        own, echoed = F.when(~echo, value), F.when(echo, value)
        running += [
            F.sum(own).over(upto).alias(f"_hs_{name}"),
            F.count(own).over(upto).alias(f"_hn_{name}"),
            F.sum(echoed).over(since).alias(f"_ts_{name}"),
            F.count(echoed).over(since).alias(f"_tn_{name}"),
        ]
    ended = copies.select("*", *running).where(~echo)
    parts = "ht"

    if widths is not None:
        totals = []
        for name, value in values.items():
            totals += [F.sum(value).alias(f"_s_{name}"), F.count(value).alias(f"_n_{name}")]
        # Full panes start after the range begins and before the own pane, whatever the key's width.
        between = Window.partitionBy(key).orderBy("_pane").rangeBetween(1 - size_us, -1)
        middle = base.groupBy(key, "_pane").agg(*totals).select(
            key,
            "_pane",
            *[F.sum(f"_s_{name}").over(between).alias(f"_ms_{name}") for name in values],
            *[F.sum(f"_n_{name}").over(between).alias(f"_mn_{name}") for name in values],
        )
        ended = ended.join(middle, [key, "_pane"])
        parts = "htm"

    results = []
    for name in values:
        n = _plus(*[F.col(f"_{part}n_{name}") for part in parts])
        total = _plus(*[F.col(f"_{part}s_{name}") for part in parts])
        results += [(total / F.nullif(n, F.lit(0))).alias(name), n.alias(f"n_{name}")]
    return ended.select(*original, *results)


def sensor_trailing_means(readings: DataFrame, size_us: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per reading, the mean of its sensor over [t - size, t]."""
    return trailing_means(readings, "sensor_id", {"average": F.col("reading")}, size_us,
                          closed=True, rows_per_task=rows_per_task)


def motor_trailing_means(readings: DataFrame, size_us: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per reading, the channel means of its motor over (t - size, t]; an empty channel is null."""
    return trailing_means(readings, "motor_id", per_channel(F.col("reading")), size_us,
                          closed=False, rows_per_task=rows_per_task)
