"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A document's size is its number of words. Sources, by code point and null last, weigh 5, 2, 1, repeating, and share
the words of all documents by weight. No source gets more than `max_epochs` times its own size; what it cannot take is shared
again by weight among the rest until none is above. Targets become whole blocks by highest quotients target / (2 j + 1),
a source's blocks become quotas of its shards in the same way with the shard sizes as votes, and each shard takes its
quota from its documents in a seeded order, from a seeded block on and around.

Defined cases: a null text is empty; an empty text has size 0 and takes 0, and `mixture` keeps it once. A null source is a source of its own.
Rows repeated in every column are documents of their own. A null id is kept. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwatch.llm.tables import saved, small_side, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 16
SHARD_DOCS = 2048
MAX_SHARDS = 4096
SEED = 20240101


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def highest_quotients(votes: DataFrame, keys: list[str], seats: str, by: list[str]) -> DataFrame:
    """Sainte-Laguë: add `quota`, how many of the `seats` go to a row by the highest quotients votes / (2 j + 1).

    votes: rows with `votes` (not negative) and `seats`, the same in all rows of a key. Equal quotients go by `by`. The divisor
    votes / seats leaves the right number of seats but for half a seat a row, so only quotients next to it are ranked: about
    three candidates a row instead of one for each seat.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.count("*").over(group)
    total = F.sum("votes").over(group)
    sized = votes.withColumn("_n", n).withColumn("_total", total.cast("double"))
    live = (F.col("_total") > 0) & (F.col(seats) > 0)

    def at(house: Column) -> Column:
        """Seats of a row if the divisor were total / house."""
        return F.floor(F.col("votes") * house / F.col("_total") + 0.5)

    # With so many seats in all a divisor yields no more, or no fewer, than asked for.
    low = F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0.0))
    high = F.col(seats) + F.col("_n") / 2 + 1
    sized = (sized.withColumn("_sure", F.when(live, F.greatest(at(low), F.lit(0))).otherwise(0).cast("bigint"))
             .withColumn("_most", F.when(live, at(high)).otherwise(0).cast("bigint")))
    sized = sized.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    seat = F.explode_outer(F.when(F.col("_most") > F.col("_sure"),
                                  F.sequence(F.col("_sure"), F.col("_most") - 1))).alias("_seat")
    open_seats = sized.select("*", seat).withColumn("_quotient", F.col("votes") / (2 * F.col("_seat") + 1))
    turn = group.orderBy(F.desc_nulls_last("_quotient"), *[F.asc_nulls_last(c) for c in by], "_seat")
    won = (F.col("_seat").isNotNull() & (F.row_number().over(turn) <= F.col("_left"))).cast("bigint")
    columns = votes.columns
    return (open_seats.withColumn("_won", won).groupBy(*columns, "_sure").agg(F.sum("_won").alias("_more"))
            .select(*columns, (F.col("_sure") + F.col("_more")).alias("quota")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add `target` to rows (source, source_size): shares by weight, stopped at max_epochs times the size.

    Sources in the order of cap / weight reach their caps one after the other, so running sums give the level at which
    the rest share. It is one row per source, sorted in one task.
    """
    all_rows = Window.partitionBy(F.lit(0))
    place = F.row_number().over(all_rows.orderBy(F.asc_nulls_last("source"))) - 1
    weight = reduce(lambda rest, k: F.when(F.col("_place") % len(weights) == k, weights[k]).otherwise(rest),
                    range(len(weights)), F.lit(None))
    rows = (sources.withColumn("_place", place).withColumn("_weight", weight.cast("double"))
            .withColumn("_cap", F.col("source_size").cast("double") * max_epochs))
    before = all_rows.orderBy(F.col("_cap") / F.col("_weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_total", F.sum("source_size").over(all_rows).cast("double"))
            .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
            .withColumn("_heavy", F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
            .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_heavy")))
    # The level holds for the first source that stays below its cap, and for all after it.
    below = F.col("_level") * F.col("_weight") <= F.col("_cap")
    level = F.min_by(F.when(below, F.col("_level")), F.when(below, F.struct(F.col("_cap") / F.col("_weight"), "_place")))
    rows = rows.withColumn("_final", level.over(all_rows))
    shared = F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap"))
    return rows.select(*sources.columns, F.least("_cap", shared).alias("target"))


def _edge(block: Column) -> Column:
    """Words of a shard before a block; blocks differ by one word at most."""
    return F.call_function("div", block * F.col("_shard_size"), F.col("_blocks"))


def _overlap(start: Column, end: Column) -> Column:
    return F.greatest(F.least(F.col("_end"), end) - F.greatest(F.col("_start"), start), F.lit(0).cast("bigint"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS,
          seed: int = SEED, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and the carried columns.

    taken counts words, repeats included: whole rounds of a shard and the part of a document that lies in the blocks
    of the last round. Only sizes are shuffled, never texts.
    """
    carry = carry or {}
    rows = saved(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(text_of(text_col)).alias("size"), *[c.alias(n) for n, c in carry.items()]), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    sources = targets(sources, weights, max_epochs)
    all_sources = Window.partitionBy(F.lit(0))
    house = F.round(F.sum("source_size").over(all_sources) / block_words).cast("bigint")
    sources = highest_quotients(
        sources.withColumn("votes", F.col("target")).withColumn("seats", house), [], "seats", ["source"])
    sources = saved(sources.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("_quota"),
        F.least(F.greatest(F.ceil(F.col("_docs") / SHARD_DOCS), F.lit(1)), F.lit(MAX_SHARDS)).alias("_shards")), "sources")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = (rows.join(small_side(sources), F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_key", key).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.col("_shards"))))
    shards = (rows.groupBy("_source", "_shard", "_quota").agg(F.sum("size").alias("_shard_size"))
              .withColumn("_votes_source", F.struct(F.col("_source").isNull(), "_source")))
    shards = highest_quotients(shards.withColumn("votes", F.col("_shard_size").cast("double")), ["_votes_source"],
                               "_quota", ["_shard"])
    blocks = F.greatest(F.round(F.col("_shard_size") / block_words), F.lit(1)).cast("bigint")
    shards = (shards.withColumn("_blocks", blocks)
              .withColumn("_quota", F.least("quota", max_epochs * F.col("_blocks")))
              .select(F.col("_source").alias("_s"), F.col("_shard").alias("_k"), "_shard_size", "_blocks",
                      F.call_function("div", "_quota", "_blocks").alias("_rounds"),
                      (F.col("_quota") % F.col("_blocks")).alias("_rest"),
                      F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.col("_blocks")).alias("_first")))
    shards = (shards.withColumn("_from", _edge(F.col("_first")))
              .withColumn("_to", _edge(F.least(F.col("_first") + F.col("_rest"), F.col("_blocks"))))
              .withColumn("_around", _edge(F.greatest(F.col("_first") + F.col("_rest") - F.col("_blocks"), F.lit(0)))))
    order = Window.partitionBy("_source", "_shard").orderBy("_key", "size", *carry)
    placed = (rows.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_start", F.col("_end") - F.col("size")))
    zero = F.lit(0).cast("bigint")
    last = _overlap(F.col("_from"), F.col("_to")) + _overlap(zero, F.col("_around"))
    joined = placed.join(shards, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k")))
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("_rounds") * F.col("size") + last).alias("taken"), *carry)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix takes it, to the nearest whole.

    Documents meet their counts by id and by a hash of the whole row, so rows that share an id keep their own count. Rows
    repeated in every column have one count together and come out that often. Documents without words take nothing
    from a target and stay once each.
    """
    row = F.struct("*")
    digest = F.xxhash64(F.to_json(row))
    taken = mixed(docs, id_col, text_col, source_col, carry={"_digest": digest}).select(
        F.col("doc_id").alias("_id"), "_digest", "size", "taken")
    copies = F.when(F.max("size") == 0, F.count("*")).otherwise(F.round(F.sum("taken") / F.max("size"))).cast("bigint")
    counted = taken.groupBy("_id", "_digest").agg(copies.alias("_times"), F.count("*").alias("_rows"))
    rows = docs.select(row.alias("_row"), digest.alias("_key"), F.col(id_col).alias("_own"))
    met = (rows.join(saved(counted, "taken"), (F.col("_key") == F.col("_digest")) & F.col("_own").eqNullSafe(F.col("_id")))
           .where("_times > 0").select("_row", "_own", "_key", "_times", "_rows"))
    repeated = met.where("_rows > 1").groupBy("_own", "_key").agg(F.first("_row").alias("_row"), F.first("_times").alias("_times"))
    single = met.where("_rows = 1").select("_row", "_times").unionByName(repeated.select("_row", "_times"))
    return single.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).select("_row.*")
