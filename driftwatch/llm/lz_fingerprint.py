"""Lempel-Ziv phrase fingerprints and the likeness of each document to an edited form and to the next document.

A text is parsed into phrases: each is the shortest stretch from where the last one ended that is not a phrase yet. The set of
phrases is hashed, and the least hash in each of BINS bins makes the signature, one byte a bin. The likeness of two
signatures is the share of equal bins among those that are filled in either, corrected for chance agreement of bytes.

The edited text of a document has its last floor(n / 4) code points replaced by as many of the first ones (or all) of
the next document by ascending id; the last is followed by the first. Documents are dealt to ranges of ids, sorted there and
streamed, so a task holds two texts and its batch. The first document of each range is dealt to the range before as well.

Defined cases: a null text is empty, and the signature of an empty text has no filled bin. Two empty signatures have
likeness 1, an empty and another one 0. A null id comes after all others; rows that share an id follow each other by the
hash of their texts. A lone document is its own next. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.tables import saved, text_of

BINS = 256
EMPTY = np.uint32(0xFFFFFFFF)
SHIFT = np.uint32(24)
ROWS_OUT = 512


def phrases(text: str, known: set[str], start: str = "") -> tuple[set[str], str]:
    """Add the phrases of a text to a set; also what is left unfinished at its end."""
    phrase, add = start, known.add
    for char in text:
        phrase += char
        if phrase not in known:
            add(phrase)
            phrase = ""
    return known, phrase


def minima(found: set[str]) -> np.ndarray:
    """The least hash of each bin; the upper byte of a phrase's hash is its bin."""
    out = np.full(BINS, EMPTY, np.uint32)
    if found:
        # The checksum is linear in its input; a multiplication spreads it over all bits.
        hashes = np.fromiter((crc32(p.encode("utf-8", "surrogatepass")) for p in found), np.uint64, len(found))
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        hashes = np.sort(mixed.astype(np.uint32))
        bins, first = np.unique(hashes >> SHIFT, return_index=True)
        out[bins] = hashes[first] & np.uint32(0x00FFFFFF)
    return out


def signature(least: np.ndarray) -> bytes:
    """A byte for each bin, 0 if it is empty."""
    return np.where(least == EMPTY, 0, 1 + least % 255).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    filled = int(((x > 0) | (y > 0)).sum())
    if not filled:
        return 1.0
    equal = int(((x == y) & (x > 0)).sum()) / filled
    return max(0.0, (equal - 1 / 255) / (1 - 1 / 255))


def _signed(text: str, head: str) -> tuple[bytes, bytes, str]:
    """Signatures of a text and of its edited form, and the edited form; both share the parse of what they share."""
    replaced = len(text) // 4
    cut = len(text) - replaced
    known, rest = phrases(text[:cut], set())
    edited = text[:cut] + head[:replaced]
    shared = minima(known)
    tail, left = phrases(text[cut:], _Added(known), rest)
    changed, over = phrases(head[:replaced], _Added(known), rest)
    mine = np.minimum(shared, minima(tail.added | ({left} - {""})))
    other = np.minimum(shared, minima(changed.added | ({over} - {""})))
    return signature(mine), signature(other), edited


class _Added:
    """A set on top of one that stays as it is."""

    def __init__(self, base: set[str]):
        self.base, self.added = base, set()
        self.add = self.added.add

    def __contains__(self, phrase: str) -> bool:
        return phrase in self.base or phrase in self.added


def _ranges(docs: DataFrame, id_col: str, count: int) -> list[int]:
    """Ids that split the rows evenly: the last id of each range but the last."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL")
    shares = [k / count for k in range(1, count)]
    cuts = sorted(set(ids.approxQuantile("id", shares, 0.1 / count))) if shares else []
    return [int(c) for c in cuts]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    # Only the cuts between ranges come to the driver, one id for each.
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _ranges(docs, id_col, ranges)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    place = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        place = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(
            F.array_size(F.filter(edges, lambda edge: edge < F.col("doc_id"))))
    rows = (rows.withColumn("tie", F.xxhash64("text")).withColumn("range", place.cast("int"))
            .withColumn("order", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")))
    # The first row of a range closes the one before it; the first of all closes the last.
    firsts = saved(rows.groupBy("range").agg(F.min("order").alias("order")), "firsts")
    heads = sorted((r["range"], tuple(r["order"])) for r in firsts.collect())
    before = {at: heads[k - 1][0] for k, (at, _) in enumerate(heads)}
    first = F.lit(None).cast("int")
    if heads:
        table = F.create_map(*[F.lit(x) for at, _ in heads for x in (at, before[at])])
        head_ids = F.create_map(*[c for at, (_, doc, tie) in heads for c in (
            F.lit(at), F.struct(F.lit(doc).cast("bigint").alias("doc_id"), F.lit(tie).cast("bigint").alias("tie")))])
        head = head_ids[F.col("range")]
        is_head = F.col("doc_id").eqNullSafe(head["doc_id"]) & (F.col("tie") == head["tie"])
        first = F.when(is_head, table[F.col("range")])
    dealt = rows.withColumn("copy", first).select(
        "doc_id", "text", "tie", F.explode(F.array_compact(F.array(
            F.struct(F.col("range"), F.lit(0).alias("closing")),
            F.when(F.col("copy").isNotNull(), F.struct(F.col("copy").alias("range"), F.lit(1).alias("closing")))))).alias("at"))
    dealt = dealt.select("doc_id", "text", "tie", "at.range", "at.closing")
    dealt = (dealt.repartition(ranges, "range")
             .sortWithinPartitions("range", "closing", F.asc_nulls_last("doc_id"), "tie")
             .select("doc_id", "text", "range", "closing"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come with their range sorted by id and closed by the next document; each is compared with its next."""
        held, signed, out = None, None, []
        closed = True
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                doc, text, at, closing = (c[k].as_py() for c in columns)
                if held is not None and held[2] == at and not closed:
                    mine, other, edited = _signed(held[1], text)
                    if signed is not None:
                        signed[-1] = likeness(signed[3], mine)
                        out.append(signed[:3] + signed[4:])
                    signed = [held[0], len(held[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                              mine, mine.hex(), other.hex(), likeness(mine, other), 0.0]
                if closing and not closed:
                    own = fingerprint(text)
                    signed[-1] = likeness(signed[3], own)
                    out.append(signed[:3] + signed[4:])
                    signed, held, closed = None, None, True
                elif not closing:
                    held, closed = (doc, text, at), False
                if len(out) >= ROWS_OUT:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(compare, schema)


def _all(text: str) -> set[str]:
    """All phrases of a text, the unfinished one at its end included."""
    known, rest = phrases(text, set())
    return known | ({rest} - {""})


def fingerprint(text: str) -> bytes:
    return signature(minima(_all(text)))


def _batch(rows: list[list], schema: T.StructType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.fieldNames())
