"""Near-duplicate documents by BagMinHash over the multiset of their word shingles.

The weight of a shingle is how often it occurs. Weights are cut at powers of two; each piece of the weight axis is the source of
a Poisson process whose rate is its length, seeded by the shingle and the piece. Pieces below the weight count in full,
and of the one that holds it the points whose mark lies below the weight. A point falls into one of SLOTS slots, and
the earliest point of a slot is the signature there. Two documents agree in a slot with a probability of their weighted
Jaccard similarity. A process ends once its next point is later than all slots of its document, so most end
after one. A sketch of four bits a slot rules out candidates far below the threshold before their texts are fetched; of pairs at the
threshold it loses about 3 in a million.

Documents with equal multisets are one class at once. The others are cut into bands, candidates are verified by exact
multiset overlap, and verified links are joined by distributed union-find (`linking`).

Defined cases: null and empty texts, or white space alone, have no shingle and are classes of their own. Fewer than five words are one
shingle. A null id is kept and comes after all others. Rows repeated in id and text are members of one class. Ties keep the smallest id.
An empty table gives no rows. Other columns are kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.linking import classes, shared_buckets
from driftwatch.llm.tables import saved, small_side, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
SLOTS = BANDS * ROWS
PLANES, DEVIATIONS = 4, 4.5
SKETCH = [f"{plane}_{word}" for plane in range(PLANES) for word in range(-(-SLOTS // 64))]
BATCH_DOCS = 1024
BATCH_SHINGLES = 2_000_000
CACHED_WORDS = 300_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all of them."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


class Shingles:
    """Multisets of word shingles as (sorted hashes, counts), with a bounded cache of word hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        words = text.lower().split()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(hashes))
        if not width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = np.full(len(hashes) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = _mixed(rolled * BASE + hashes[k:len(hashes) - width + 1 + k])
        return np.unique(rolled, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SLOTS times for each multiset; an empty one has no finite time."""
    n = len(bags)
    slots = np.full(n * SLOTS, np.inf)
    shingle = np.concatenate([b for b, _ in bags]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), [len(b) for b, _ in bags])
    # Piece 0 is [0, 1), piece k is [2^(k-1), 2^k).
    parts, piece = [], 0
    while True:
        low = 0 if piece == 0 else 1 << (piece - 1)
        has = np.nonzero(weight > low)[0]
        if not len(has):
            break
        seed = _mixed(shingle[has] + np.uint64(int(GOLDEN) * (piece + 1) % 2 ** 64))
        length = max(low, 1)
        parts.append((doc[has], seed, np.full(len(has), float(length)), np.full(len(has), float(low)), weight[has]))
        piece += 1
    if not parts:
        return slots.reshape(n, SLOTS)
    doc, seed, length, low, weight = (np.concatenate(x) for x in zip(*parts))
    time = np.zeros(len(doc))
    state = seed
    while len(doc):
        state = _mixed(state + GOLDEN)
        time = time - np.log(_unit(state)) / (length * SLOTS)
        other = _mixed(state ^ MIX_B)
        counts = low + length * _unit(_mixed(other ^ MIX_A)) <= weight
        at = doc * SLOTS + (other % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(slots, at[counts], time[counts])
        latest = slots.reshape(n, SLOTS).max(1)
        live = time < latest[doc]
        doc, state, length, low, weight, time = (x[live] for x in (doc, state, length, low, weight, time))
    return slots.reshape(n, SLOTS)


def band_hashes(slots: np.ndarray) -> np.ndarray:
    bits = slots.view(np.uint64).reshape(len(slots), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(slots), BANDS)).copy()
    for k in range(ROWS):
        out = _mixed(out * BASE + bits[:, :, k])
    return out.view(np.int64)


def sketches(slots: np.ndarray) -> np.ndarray:
    """PLANES bits of each slot, plane by plane in longs: equal slots agree, others in one of sixteen."""
    mixed = _mixed(slots.view(np.uint64))
    planes = []
    for k in range(PLANES):
        ones = ((mixed >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes.append(np.packbits(np.pad(ones, ((0, 0), (0, -SLOTS % 64))), axis=1).view(np.int64))
    return np.concatenate(planes, axis=1)


def places_apart(similarity: float) -> int:
    """Most differing places of a candidate: what a pair at the threshold is expected to have, and DEVIATIONS standard deviations more."""
    share = (1 - similarity) * (1 - 0.5 ** PLANES)
    return int(SLOTS * share + DEVIATIONS * (SLOTS * share * (1 - share)) ** 0.5)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at], b[1][bt]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("hi", T.LongType()),
    T.StructField("lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.StructType([T.StructField(name, T.LongType()) for name in SKETCH]))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        docs, ties, bags = zip(*rows)
        slots = signatures(list(bags))
        digests = [xxhash.xxh3_128_digest(b.tobytes() + c.tobytes()) if len(b) else None for b, c in bags]
        whole = [[None if d is None else int.from_bytes(d[k:k + 8], "big", signed=True) for d in digests] for k in (0, 8)]
        bands = pa.array([x.tolist() if len(b) else None for x, (b, _) in zip(band_hashes(slots), bags)], pa.list_(pa.int64()))
        sketch = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in sketches(slots).T], SKETCH)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in (docs, ties, *whole)], bands, sketch],
            names=FEATURES.fieldNames())

    for batch in batches:
        rows, total = [], 0
        for doc, tie, text in zip(*(batch.column(k) for k in range(3))):
            bag = shingles.of(text.as_py())
            rows.append((doc.as_py(), tie.as_py(), bag))
            total += len(bag[0])
            if len(rows) >= BATCH_DOCS or total >= BATCH_SHINGLES:
                yield emit(rows)
                rows, total = [], 0
        if rows:
            yield emit(rows)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of similar texts. Pairs of one `a` follow each other, so its shingles are made once."""
    joined = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
              .sortWithinPartitions("a").select("a", "b", "text_a", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, bag = Shingles(), None, None
        for batch in batches:
            links = []
            for a, b, text_a, text_b in zip(*(batch.column(k) for k in range(4))):
                if a.as_py() != last:
                    last, bag = a.as_py(), shingles.of(text_a.as_py())
                if overlap(bag, shingles.of(text_b.as_py())) >= similarity:
                    links.append((last, b.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(check, "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, tie (a hash of its text), class_id (the least doc_id of its class), class_tie, class_size.

    Members of a class are connected by links of the given similarity or more.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    features = saved(rows.mapInArrow(_features, FEATURES), "features")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    bags = saved(features.where("hi IS NOT NULL").groupBy("hi", "lo").agg(
        F.min(order).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("id", F.monotonically_increasing_id()), "bags")
    members = saved(shared_buckets(bags.select(F.explode("bands").alias("bucket"), "id")), "members")
    wanted = (bags.join(members.select("id").distinct(), "id", "left_semi")
              .select("id", F.col("first.doc_id").alias("_doc"), F.col("first.tie").alias("_tie")))
    wanted = small_side(saved(wanted, "wanted"))
    texts = saved(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")))
                  .select("id", "text").dropDuplicates(["id"]), "texts")
    roots = saved(classes(members, lambda pairs: _verified(pairs, texts, similarity), bags.select("id", "sketch"),
                          places_apart(similarity)), "roots")
    rooted = bags.select("hi", "lo", "first", "n", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    known = saved(rooted.join(heads, "root").select("hi", "lo", "head", "class_size"), "classes")
    return features.drop("bands", "sketch").join(known, ["hi", "lo"], "left").select(
        "doc_id", "tie",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(F.col("head").isNull(), F.col("tie")).otherwise(F.col("head.tie")).alias("class_tie"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one with the least id."""
    found = near_classes(docs, id_col, text_col)
    out = found.where(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tie") == F.col("class_tie"))))
    out = saved(out.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct(), "others")
    # Each document travels as a struct, so that its columns may have any name.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_of(text_col)).alias("digest"))
    same = F.col("doc").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_tie"))
    rest = rows.join(small_side(out), same, "left_anti")
    # Rows repeated in id and text are copies too.
    twice = saved(found.where("class_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).count()
                  .where("count > 1").select("_id", "_tie", F.lit(True).alias("twice")), "twice")
    marked = rest.join(small_side(twice), same, "left")
    once = (marked.where("twice").groupBy("doc", "digest")
            .agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))
    return marked.where("twice IS NULL").select("row.*").unionByName(once)
