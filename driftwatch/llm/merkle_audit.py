"""Fixity audit of WARC replicas by Merkle trees over records and offset ranges.

Records lie in archive files at byte offsets. The leaf of a tree is the digest of a record at its offset; a node covers an
aligned range of offsets and hashes its children in order, FANOUT of them at most. Replicas are compared root by root,
and only ranges that differ are descended, level by level, until records are named: altered, missing from a replica, or extra there.

Defined cases: a null payload is an empty record and a null URL an empty header field. Records repeated at one offset are
one child each, by digest. A file in one replica only is reported record by record. Equal replicas, empty ones among them, give no rows.
Very long records count by their digest alone. Columns other than the named ones play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwatch.llm.tables import saved

FANOUT_BITS = 4
LEAF_BITS = 12
FILE_RECORDS = 512


def warc_record(url: Column, payload: Column) -> Column:
    """A response record as it stands in the file."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             file_records: int = FILE_RECORDS) -> DataFrame:
    """Pages laid out in archive files by id: file, offset, length, record_id, record."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("record_id"), warc_record(F.col(url_col), F.col(html_col)).alias("record"))
    file = F.call_function("div", F.coalesce("record_id", F.lit(-1)), F.lit(file_records).cast("bigint"))
    rows = rows.withColumn("file", file).withColumn("length", F.octet_length("record").cast("bigint"))
    order = Window.partitionBy("file").orderBy("record_id", F.xxhash64("record"))
    end = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", (end - F.col("length")).alias("offset"), "length", "record_id", "record")


def leaves(records: DataFrame, *columns: str) -> DataFrame:
    """(file, offset, digest) of the records of a replica, and further columns."""
    return records.select("file", "offset", F.sha2("record", 256).alias("digest"), *columns)


def tree(leaf_rows: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file, range, digest) by level. Level 0 covers 2 ** LEAF_BITS bytes, each further level FANOUT times as many."""
    range_of = F.shiftright("offset", LEAF_BITS)
    out = [saved(_hashed(leaf_rows.withColumn("range", range_of), F.struct("offset", "digest")), "nodes")]
    for _ in range(levels):
        below = out[-1].withColumn("child", F.col("range")).withColumn("range", F.shiftright("range", FANOUT_BITS))
        out.append(saved(_hashed(below, F.struct("child", "digest")), "nodes"))
    return out


def _hashed(rows: DataFrame, child: Column) -> DataFrame:
    """A node per file and range. It has at most as many children as records start in a leaf range, or FANOUT."""
    ordered = F.sort_array(F.collect_list(child))
    return rows.groupBy("file", "range").agg(F.sha2(F.to_json(ordered), 256).alias("digest"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Rows file, offset, state (altered, missing, extra), digest, replica_digest, record_id of records that differ.

    Both sides: file, offset, record_id, record.
    """
    mine = saved(leaves(primary, "record_id"), "leaves")
    other = saved(leaves(replica, "record_id"), "leaves")
    # One number comes back: the last offset decides how many levels bring every file under one root.
    last = mine.select("offset").unionByName(other.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = 0
    while last >> (LEAF_BITS + FANOUT_BITS * levels):
        levels += 1
    trees = tree(mine, levels), tree(other, levels)
    suspect = None
    for level in range(levels, -1, -1):
        a, b = (t[level] for t in trees)
        if suspect is not None:
            up = suspect.select("file", F.col("range").alias("up"))
            a, b = (_below(t, up) for t in (a, b))
        both = a.join(b.withColumnRenamed("digest", "other"), ["file", "range"], "full_outer")
        suspect = saved(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "range"), "suspects")
    rows = [t.withColumn("range", F.shiftright("offset", LEAF_BITS)).join(suspect, ["file", "range"], "left_semi").drop("range")
            for t in (mine, other)]
    # Records at one offset are told apart by digest; what both have is no finding.
    left = rows[0].groupBy("file", "offset", "digest").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"))
    right = rows[1].groupBy("file", "offset", "digest").agg(F.min("record_id").alias("other_id"), F.count("*").alias("m"))
    odd = left.join(right, ["file", "offset", "digest"], "full_outer").where("NOT n <=> m")
    found = odd.groupBy("file", "offset").agg(
        F.min(F.when(F.coalesce("n", F.lit(0)) > F.coalesce("m", F.lit(0)), F.col("digest"))).alias("digest"),
        F.min(F.when(F.coalesce("m", F.lit(0)) > F.coalesce("n", F.lit(0)), F.col("digest"))).alias("replica_digest"),
        F.min("record_id").alias("record_id"), F.min("other_id").alias("other_id"))
    state = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("altered")
    return found.select("file", "offset", state.alias("state"), "digest", "replica_digest",
                        F.coalesce("record_id", "other_id").alias("record_id"))


def _below(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """The nodes of a level under suspect nodes of the level above."""
    return (nodes.withColumn("up", F.shiftright("range", FANOUT_BITS)).join(up, ["file", "up"], "left_semi").drop("up"))
