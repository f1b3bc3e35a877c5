"""Exact deduplication by progressive refinement: length, then the hash of a prefix, then the hash of the whole.

Texts are equal when they are the same after their white space (space and U+0009 to U+000D) is deleted. Of equal
texts the row with the most code points in its original text stays, then the one with the smallest id.

Defined cases: a null text is empty, and empty texts are equal to each other. A null id comes after all others
and is reported as null. Rows repeated in id and text are members of one group; exactly one of them is kept. An empty table
gives no rows. Columns other than id and text take no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.tables import BROADCAST_ROWS, saved, text_of

PREFIX = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _sized(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    return (docs.select(*columns, text_of(text_col).alias("_text"))
            .withColumn("_norm", normalised(F.col("_text")))
            .withColumn("_len", F.length("_norm"))
            .withColumn("_head", F.xxhash64(F.substring("_norm", 1, PREFIX))))


def _collisions(docs: DataFrame, text_col: str) -> DataFrame:
    """(length, prefix hash) of more than one text: the first two refinements, on a few bytes per document."""
    sized = saved(_sized(docs, text_col).select("_len", "_head"), "lengths")
    lengths = sized.groupBy("_len").count().where("count > 1").select("_len")
    # Prefixes are counted ahead of the join, so that many texts of one length meet as one row for each prefix.
    heads = sized.groupBy("_len", "_head").count().join(lengths, "_len", "left_semi").where("count > 1")
    return saved(heads.select("_len", "_head", F.lit(True).alias("_open")), "prefixes")


def _refined(docs: DataFrame, text_col: str, broadcast_rows: int, *columns: Column) -> DataFrame:
    """Rows with the hash of the whole text where length and prefix did not settle the matter, else null.

    The colliding prefixes are broadcast while a count bounds them. Beyond that every text is hashed where it is
    read, as moving the texts to their prefixes would cost more; the groups are the same.
    """
    collisions = _collisions(docs, text_col)
    sized = _sized(docs, text_col, *columns)
    if collisions.count() <= broadcast_rows:
        sized = sized.join(F.broadcast(collisions), ["_len", "_head"], "left")
    else:
        sized = sized.withColumn("_open", F.lit(True))
    return sized.withColumn("_full", F.when(F.col("_open"), F.sha2("_norm", 256)))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, full_sha256, keep_id, group_size, kept, and the carried columns.

    full_sha256 is null where length or prefix already showed that no other text is equal. carry names further
    columns computed from a document where it is read.
    """
    carry = carry or {}
    named = [column.alias(name) for name, column in carry.items()]
    rows = saved(_refined(docs, text_col, broadcast_rows, F.col(id_col).alias("doc_id"), *named)
                 .select("doc_id", F.length("_text").alias("n_chars"), "_full", *carry), "digests")
    alone = rows.where(F.col("_full").isNull()).select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    open_rows = rows.where(F.col("_full").isNotNull())
    # Rows repeated in id and text are counted, so that one of them can be told from the rest.
    members = open_rows.groupBy("_full", "doc_id", "n_chars", *carry).agg(F.count("*").alias("_times"))
    groups = open_rows.groupBy("_full").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("shortfall"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
        .alias("best"))
    joined = members.join(groups, "_full").select(
        "doc_id", "n_chars", "_full", *carry, F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.shortfall")))
        .alias("_best"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_turn"))
    kept = joined.withColumn("kept", F.col("_best") & (F.col("_turn") == 1)).drop("_best", "_turn")
    return alone.unionByName(kept).withColumnRenamed("_full", "full_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that stay, with all their columns. Only texts with a colliding prefix are shuffled."""
    names = docs.columns
    whole = F.struct(*[docs[name] for name in names]).alias("_row")
    rows = _refined(docs, text_col, broadcast_rows, whole, F.col(id_col).alias("_id"))
    alone = rows.where(F.col("_full").isNull()).select("_row.*")
    order = F.struct((-F.length("_text")).alias("shortfall"), F.col("_id").isNull().alias("unnamed"), "_id",
                     F.xxhash64(F.to_json("_row")).alias("tie"))
    kept = rows.where(F.col("_full").isNotNull()).groupBy("_full").agg(F.min_by("_row", order).alias("_row"))
    return alone.unionByName(kept.select("_row.*"))
