"""Substring deduplication by unit hashes: sentences are normalised and hashed, equal digests grouped over all documents, the
occurrence ranked first stays and the others are removed, with their offsets in the original text.

A unit is a sentence or the rest of a line; its digest ignores case and the width of white space. So that passages are found wherever
they stand in a line, stretches of STRETCH words are units too: of any REACH that begin at neighbouring words the one of the least hash
is taken, which depends on these words alone, so copies have the same stretches. Ranks go by document id, then place. Repeated
units that overlap or touch form a run. A run goes if it has RUN_WORDS words or fills whole lines with LINE_WORDS words in all; shorter
ones stay, since a few words repeat by chance in texts that share nothing. A repeated passage of RUN_WORDS + 2 * (REACH - 1) words or
more always goes but for at most REACH - 1 words at each end.

Defined cases: null and empty texts have no units. A null id ranks after all others. Rows repeated in id and text are one
document. A stretch that overlaps the one it repeats goes from the end of that on. Very long texts are one row each and are never cut. An empty table gives no rows. Other columns are kept by `cleaned`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftwatch.llm.tables import saved, text_of

RUN_WORDS = 20
LINE_WORDS = 8
STRETCH, REACH = 12, 9
UNIT = re.compile(r"[^\n.!?]*[^\s.!?][^\n.!?]*[.!?]*")
BATCH_DOCS = 512
CACHED_WORDS = 300_000

UNITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("unit", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.IntegerType()),
    T.StructField("opens", T.BooleanType()), T.StructField("closes", T.BooleanType()),
    T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
    T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])

_SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_MARKS = np.isin(np.arange(0x3002), [ord(c) for c in ".!?"])
_FACTORS = np.random.default_rng(20240101).integers(0, 1 << 64, (2, STRETCH), np.uint64) | np.uint64(1)


def units(text: str) -> list[tuple]:
    """(start, end, words, opens a line, closes a line, digest) of each unit; offsets count code points."""
    out = []
    for match in UNIT.finditer(text):
        start, end = match.span()
        words = match[0].lower().split()
        start += len(match[0]) - len(match[0].lstrip())
        line = text.rfind("\n", max(0, start - 64), start)
        opens = not text[line + 1 if line >= 0 else max(0, start - 64):start].strip() and (line >= 0 or start < 64)
        rest = text[end:end + 64].split("\n", 1)
        closes = not rest[0].strip() and (len(rest) == 2 or end + 64 >= len(text))
        out.append((start, end, len(words), opens, closes, xxhash.xxh3_128_digest(" ".join(words))))
    return out


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Starts, ends, whether they open or close a line, and lower case of the words; marks of sentences alone are none."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x3001)
    blank = _SPACES[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    words = text.lower().split()
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    breaks = np.concatenate(([True], lines[starts[1:]] > lines[ends[:-1]], [True]))
    solid = np.concatenate(([0], np.cumsum(~(blank | _MARKS[codes]))))
    real = solid[ends] > solid[starts]
    opens, closes = breaks[:len(starts)], breaks[1:len(starts) + 1]
    if not real.all():
        words = [w for w, r in zip(words, real.tolist()) if r]
    return starts[real], ends[real], opens[real], closes[real], words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(words: list[str], digests: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and two halves of the digest of each stretch taken. digests: those of words seen before."""
    count = len(words) - STRETCH + 1
    if count < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    for word in set(words).difference(digests):
        digests[word] = xxhash.xxh3_128_digest(word)
    halves = np.frombuffer(b"".join(map(digests.__getitem__, words)), np.uint64).reshape(-1, 2)
    hi, lo = (_mixed(sum(halves[k:k + count, half] * _FACTORS[half, k] for k in range(STRETCH))) for half in (0, 1))
    reach = min(REACH, count)
    least = np.lib.stride_tricks.sliding_window_view(hi, reach).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return at, hi[at], lo[at]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first halves of the digests of all units, with the document."""
    digests: dict[str, bytes] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            part = batch.slice(at, BATCH_DOCS)
            found = []
            for text in part.column(2).to_pylist():
                if len(digests) > CACHED_WORDS:
                    digests.clear()
                lines = b"".join(xxhash.xxh3_128_digest(" ".join(m[0].lower().split())) for m in UNIT.finditer(text))
                _, hi, _ = stretches(places(text)[4], digests)
                found.append(np.concatenate((np.frombuffer(lines, ">i8")[::2].astype(np.int64), hi.view(np.int64))))
            source = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(source), part.column(1).take(source), pa.array(np.concatenate(found), pa.int64())], names=["doc_id", "tie", "hi"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of documents whose digests begin with one of a list."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    digests: dict[str, bytes] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            part = batch.slice(at, BATCH_DOCS)
            found = [[] for _ in kinds]
            counts = []
            for text, wanted in zip(part.column(2).to_pylist(), part.column(3)):
                if len(digests) > CACHED_WORDS:
                    digests.clear()
                starts, ends, opens, closes, words = places(text)
                sentences = units(text)
                halves = np.frombuffer(b"".join(u[5] for u in sentences), ">i8").reshape(-1, 2).astype(np.int64)
                start, end, size, opened, closed = (
                    np.array([u[k] for u in sentences], kind) for k, kind in enumerate((np.int64, np.int64, np.int64, bool, bool)))
                first, hi, lo = stretches(words, digests)
                last = first + STRETCH - 1
                columns = (
                    np.arange(len(start) + len(first)), np.concatenate((start, starts[first])), np.concatenate((end, ends[last])),
                    np.concatenate((size, np.zeros(len(first), np.int64))), np.concatenate((opened, opens[first])),
                    np.concatenate((closed, closes[last])), np.concatenate((halves[:, 0], hi.view(np.int64))),
                    np.concatenate((halves[:, 1], lo.view(np.int64))),
                    np.concatenate((np.searchsorted(ends, start, "right"), first)),
                    np.concatenate((np.searchsorted(starts, end, "left"), last + 1)))
                repeated = np.isin(columns[6], wanted.values.to_numpy())
                for column, values in zip(found, columns):
                    column.append(values[repeated])
                counts.append(int(repeated.sum()))
            source = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(source), part.column(1).take(source),
                 *[pa.array(np.concatenate(c), k) for c, k in zip(found, kinds)]], names=UNITS.fieldNames())


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """One row per removed span: doc_id, tie, start, end (code points of the original), words, keep_doc_id, keep_start.

    keep_doc_id and keep_start tell where the first unit of the span stays. tie is a hash of the text.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    # Most units occur once. Only a half digest of each is shuffled, and the others are made again with their places.
    seen = rows.mapInArrow(_keys, "doc_id bigint, tie bigint, hi bigint").withColumn("n", F.count("*").over(Window.partitionBy("hi")))
    wanted = saved(seen.where("n > 1").groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
                   .agg(F.collect_set("hi").alias("wanted")), "repeated")
    some = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).drop("_id", "_tie")
    every = saved(some.select("doc_id", "tie", "text", "wanted").mapInArrow(_units, UNITS), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie", "unit", "start", "end", "end_word")
    first = every.groupBy("hi", "lo").agg(F.min(rank).alias("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    inside = own & (F.col("first_word") < F.col("first.end_word")) & (F.col("words") == 0)
    again = (every.join(first, ["hi", "lo"]).where(rank != F.col("first"))
             .select("doc_id", "tie", "unit", F.when(inside, F.col("first.end")).otherwise(F.col("start")).alias("start"), "end", "words",
                     (F.col("opens") & ~inside).alias("opens"), "closes",
                     F.when(inside, F.col("first.end_word")).otherwise(F.col("first_word")).alias("first_word"), "end_word",
                     F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))
             .repartition("doc_id", "tie").dropDuplicates(["doc_id", "tie", "unit"]))
    # A stretch begins in the middle of what it repeats, so the units of a run may overlap.
    place = Window.partitionBy("doc_id", "tie").orderBy("first_word", "start", "unit")
    reached = F.max("end_word").over(place.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.coalesce((F.col("first_word") > reached).cast("int"), F.lit(1))
    covered = (F.max("end_word") - F.min("first_word")).cast("bigint")
    runs = (again.withColumn("ahead", ahead).withColumn("run", F.sum("ahead").over(place.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "tie", "run").agg(
                F.min("start").alias("start"), F.max("end").alias("end"), F.greatest(covered, F.sum("words")).alias("words"),
                F.min_by("opens", F.struct("start", ~F.col("opens"))).alias("opens"),
                F.max_by("closes", F.struct("end", "closes")).alias("closes"),
                F.min_by("keep_doc_id", F.struct("start", "unit")).alias("keep_doc_id"),
                F.min_by("keep_start", F.struct("start", "unit")).alias("keep_start")))
    whole_lines = F.col("opens") & F.col("closes") & (F.col("words") >= line_words)
    return runs.where((F.col("words") >= run_words) | whole_lines).select(
        "doc_id", "tie", "start", "end", "words", "keep_doc_id", "keep_start")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, the repeated spans cut from their texts; other texts stay as they are."""
    spans = (repeated_spans(docs, id_col, text_col).groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
             .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    # Each document travels as a struct, so that its columns may have any name.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc"), text_of(text_col).alias("text"))
    joined = rows.join(saved(spans, "spans"), F.col("doc").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie")), "left")
    shorter = F.when(F.col("_spans").isNull(), F.col("row").getField(text_col)).otherwise(cut(F.col("text"), F.col("_spans")))
    return joined.select(*[shorter.alias(name) if name == text_col else F.col("row").getField(name).alias(name) for name in docs.columns])


def _without(text: str, spans) -> str:
    """The text without its spans; None where there are none."""
    if spans is None:
        return text
    out, at = [], 0
    for start, end in ((s["start"], s["end"]) for s in spans):
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]
