"""Collocations by SON partitioning: phrases frequent in some shard are the candidates, all of them are counted exactly.

Documents are dealt to a fixed number of shards by hash of their id. A phrase that occurs `support` times in a language occurs at
least `support` times the shard's share of its words in one of the shards, so each shard is mined completely at that lower support,
level by level: words, then pairs of frequent words, then triples of frequent pairs, then fours of frequent triples. The support
is an absolute number, so with many small shards the local one would fall to a single occurrence; shards are few and large, and
mining one is a Spark job of its own share, spread over all tasks.

Mining goes by 64-bit hashes of phrases, which tasks count in numpy and Spark adds up. Two phrases of one hash can only
add candidates. What is frequent in a shard goes to the tasks of the next level as a bit filter of fixed size, whose
chance hits again only add candidates. The phrases frequent in any shard are then united and counted by their words, in all
documents, so every number returned is exact, as are scores, which are taken in decimals.

Memory: a task holds a block of text, its hashes, the counts it adds up (bounded) and the filter; the driver one filter and, while
parts of phrases are joined, their counts if these take BROADCAST_BYTES at most.

Defined cases: a null text is empty, a null language counts as `und`. Repeated rows and null ids count as any other row. Texts
of any length are read in blocks that end between pieces. Words of one letter case in A-Z fold together, all other characters stay
apart. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.tables import saved, text_of

SUPPORT = 30
LONGEST = 4
TOP = 2000
SHARDS = 4
SHARD_ROOM = 1 << 16
SCALE = 2_000_000
CONTAINED = 80  # percent
SALTS = 16
# What a broadcast row takes besides its texts, and what a broadcast may take in all; building it takes a few times as much.
ROW_BYTES = 64
BROADCAST_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
COUNTED_KEYS = 1 << 20
FILTER_BITS = 1 << 27
FILTER_PARTS = 1 << 10
ROWS_OUT = 1 << 17

WORD, GAP, STOP = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.full(256, WORD, np.uint8)
_CLASS[[0x20, 0x09]] = GAP
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP
_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _NEXT
    x = (x ^ (x >> np.uint64(29))) * _RADIX
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a block of texts: where they start and end, their document and which ones a piece goes on behind."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: bytes of consecutive texts, lowered; ends: where each text ends."""
        kind = _CLASS[data]
        word = kind == WORD
        fresh = np.zeros(len(data) + 1, bool)
        fresh[0] = True
        fresh[ends] = True
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        self.data = data
        self.start = np.flatnonzero(word & (~before | fresh[:-1]))
        self.end = np.flatnonzero(word & (~after | fresh[1:])) + 1
        self.length = self.end - self.start
        self.doc = np.searchsorted(ends, self.start, "right")
        piece = np.cumsum(kind == STOP)[self.start]
        self.joined = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.bytes = np.flatnonzero(word)

    def __len__(self) -> int:
        return len(self.start)

    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte of a word: the word's number and the byte's place in it; also each word's first one of these."""
        first = np.cumsum(self.length) - self.length
        number = np.repeat(np.arange(len(self), dtype=np.int32), self.length)
        return number, np.arange(len(number), dtype=np.int32) - first.astype(np.int32)[number], first

    def hashes(self) -> np.ndarray:
        _, place, first = self._places()
        powers = np.full(int(self.length.max()), _RADIX)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        return _mixed(np.add.reduceat(_BYTES[self.data[self.bytes]] * powers[place], first) + self.length.astype(np.uint64))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Equal words get equal numbers, different ones different numbers."""
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        other = first[number]
        if (self.length == self.length[other]).all():
            at, place, _ = self._places()
            if (self.data[self.bytes] == self.data[self.start[other][at] + place]).all():
                return number
        # Two words share a hash: number them by their bytes.
        raw, known = self.data.tobytes(), {}
        return np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(self.start.tolist(), self.end.tolist())])

    def texts(self, at: np.ndarray, size: int) -> list[bytes]:
        """The phrases of `size` words from the given words on, words joined by one space."""
        raw, start, end = self.data.tobytes(), self.start, self.end
        last = at + size - 1
        plain = np.ones(len(at), bool)
        for k in range(size - 1):
            plain &= (start[at + k + 1] == end[at + k] + 1) & (self.data[end[at + k]] == 0x20)
        out = [raw[s:e] for s, e in zip(start[at].tolist(), end[last].tolist())]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = b" ".join(raw[start[w]:end[w]] for w in range(at[k], last[k] + 1))
        return out


def _behind_stop(data: np.ndarray, start: int, end: int) -> int:
    """The place behind the first separator of pieces from `start` on, or the end."""
    for at in range(start, end, BLOCK_BYTES):
        found = np.flatnonzero(_CLASS[data[at:min(at + BLOCK_BYTES, end)]] == STOP)
        if len(found):
            return at + int(found[0]) + 1
    return end


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    """Blocks of words of the last column of batches, and for each word its row in the batch.

    Blocks end where texts end, and within a text longer than a block behind a separator of pieces.
    """
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        _, edges, data = column.buffers()
        if data is None or not len(column):
            continue
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        edges = np.frombuffer(edges, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        at, last = int(edges[0]), int(edges[-1])
        while at < last:
            row = int(np.searchsorted(edges, at, "right")) - 1
            limit = min(at + block_bytes, last)
            stop = int(edges[np.searchsorted(edges, limit, "right") - 1])
            if stop <= at:
                stop = _behind_stop(data, limit, int(edges[row + 1]))
            ends = edges[row + 1:np.searchsorted(edges, stop, "right")]
            ends = np.append(ends[ends < stop], stop) - at
            words = Words(_LOWER[data[at:stop]], ends)
            at = stop
            if len(words):
                yield batch, words.doc + row, words


def _runs(words: Words, size: int) -> np.ndarray:
    """For each word but the last ones, whether it and the next size - 1 lie in one piece."""
    fits = np.ones(max(len(words) - size + 1, 0), bool)
    for k in range(size - 1):
        fits &= words.joined[k:len(fits) + k]
    return fits


def _keys(hashes: np.ndarray, salts: np.ndarray, size: int) -> np.ndarray:
    """Keys of the phrases of `size` words from each word on; salts tell languages apart."""
    count = max(len(hashes) - size + 1, 0)
    key = hashes[:count]
    for k in range(1, size):
        key = _mixed(key * _NEXT + hashes[k:count + k])
    return _mixed(key ^ salts[:count])


def _in_shard(keys: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    return _mixed(keys + (np.asarray(shards) + 1).astype(np.uint64) * _RADIX)


ANY = -1  # stands for the shard of a phrase that is frequent in any


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of a filter that belong to a key."""
    width = np.uint64(64 - bits.bit_length() + 1)
    return keys >> width, (keys * _NEXT) >> width


def _holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for cells in _cells(keys, 8 * len(bitmap)):
        hit &= ((bitmap[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return hit


def _filter(keys: DataFrame, bits: int = FILTER_BITS, parts: int = FILTER_PARTS) -> np.ndarray:
    """A bit filter of fixed size over rows (key, shard), put together from parts that Spark builds."""
    size = bits // parts

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, shard = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            at = np.unique(np.concatenate(_cells(_in_shard(key.view(np.uint64), shard.astype(np.int64)), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32))],
                                             names=["part", "cell"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, cell = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for number in np.unique(part).tolist():
                held.setdefault(number, np.zeros(size, bool))[cell[part == number]] = True
        for number, marks in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())],
                names=["part", "bits"])

    rows = keys.select("key", "shard").mapInArrow(cells, "part int, cell int").repartition("part")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows.mapInArrow(packed, "part int, bits binary").toLocalIterator():
        start = row["part"] * size // 8
        bitmap[start:start + size // 8] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


class _Tally:
    """Counts of phrases by group, added up until there are many."""

    def __init__(self):
        self.groups: dict[tuple[int, ...], int] = {}
        self.parts, self.size = [], 0

    def numbers(self, columns: list[np.ndarray]) -> np.ndarray:
        """The number of each row's group; columns tell groups apart."""
        known = self.groups
        return np.array([known.setdefault(group, len(known)) for group in zip(*(c.tolist() for c in columns))], np.int32)

    def add(self, keys: np.ndarray, groups: np.ndarray) -> None:
        _, first, count = np.unique(_mixed(keys + groups.astype(np.uint64) * _RADIX), return_index=True, return_counts=True)
        self.parts.append((keys[first], groups[first], count.astype(np.int32)))
        self.size += len(first)

    def rows(self, names: list[str], kinds: list[np.dtype]) -> Iterator[pa.RecordBatch]:
        """Batches of the groups' columns, key and n. The numbers of groups hold until the next batch of texts."""
        if not self.size:
            return
        keys, groups, counts = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(_mixed(keys + groups.astype(np.uint64) * _RADIX))
        keys, groups = keys[order], groups[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1]))))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        keys, groups = keys[first].view(np.int64), groups[first]
        columns = [np.array(c, kind) for c, kind in zip(zip(*self.groups), kinds)]
        for at in range(0, len(total), ROWS_OUT):
            some = slice(at, at + ROWS_OUT)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[groups[some]]) for c in columns], pa.array(keys[some]), pa.array(total[some])],
                                             names=[*names, "key", "n"])


def _mined(rows: DataFrame, size: int, below: np.ndarray | None, by: list[str]) -> DataFrame:
    """Occurrences of phrases of `size` words by the columns `by`, of those whose parts of size - 1 words the filter holds."""
    shared = None if below is None else rows.sparkSession.sparkContext.broadcast(below)
    kinds = [np.dtype(np.int32 if rows.schema[name].dataType.simpleString() == "int" else np.int64) for name in by]

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen, numbers = _Tally(), None, None
        for batch, row, words in _blocks(batches):
            if batch is not seen:
                seen, numbers = batch, tally.numbers([batch.column(name).to_numpy(zero_copy_only=False) for name in by])
            salts = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)[row]
            hashes, fits = words.hashes(), _runs(words, size)
            if shared is not None and len(fits):
                shards = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                part = _holds(shared.value, _in_shard(_keys(hashes, salts, size - 1), shards[:len(hashes) - size + 2]))
                fits &= part[:-1] & part[1:]
            at = np.flatnonzero(fits)
            tally.add(_keys(hashes, salts, size)[at], numbers[row[at]])
            if tally.size > COUNTED_KEYS:
                yield from tally.rows(by, kinds)
        yield from tally.rows(by, kinds)

    columns = [name for name in dict.fromkeys(["salt", "shard", *by])] + ["text"]
    schema = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in by)
    counted = rows.select(*columns).mapInArrow(mine, f"{schema}, key bigint, n bigint")
    return counted.groupBy(*by, "key").agg(F.sum("n").alias("n"))


def _supports(words: DataFrame, support: int) -> DataFrame:
    """The local support of each language and shard: the support times the shard's share of words, rounded up."""
    exact = lambda name: F.col(name).cast("decimal(28,0)")
    shards = words.groupBy("salt", "shard").agg(F.sum("n").alias("words"))
    whole = words.groupBy("salt").agg(F.sum("n").alias("all_words"))
    local = F.floor((exact("words") * support + exact("all_words") - 1) / exact("all_words"))
    return shards.join(whole, "salt").select("salt", "shard", F.greatest(local.cast("bigint"), F.lit(1)).alias("local"))


def candidates(rows: DataFrame, support: int, longest: int) -> np.ndarray:
    """The filter of all phrases that are frequent in some shard, up to `longest` words."""
    words = saved(_mined(rows, 1, None, ["salt", "shard"]), "words")
    supports = saved(_supports(words, support), "supports")
    frequent = _joined(words, supports, ["salt", "shard"]).where("n >= local")
    found = [saved(frequent.select("key", "shard"), "frequent")]
    # Local support and shard in one number: that and the key are all that later levels shuffle.
    grouped = _joined(rows, supports, ["salt", "shard"]).withColumn("group", F.col("local") * SHARD_ROOM + F.col("shard"))
    for size in range(2, longest + 1):
        counted = _mined(grouped, size, _filter(found[-1]), ["group"]).where(F.col("n") >= F.floor(F.col("group") / SHARD_ROOM))
        found.append(saved(counted.select("key", (F.col("group") % SHARD_ROOM).cast("int").alias("shard")), "frequent"))
    union = found[0]
    for level in found[1:]:
        union = union.unionByName(level)
    return _filter(union.select("key").distinct().withColumn("shard", F.lit(ANY)))


def phrase_counts(rows: DataFrame, held: np.ndarray, longest: int) -> DataFrame:
    """lang, words, phrase, n of the phrases that the filter holds, exact; words 0 and phrase null for all words."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, words in _blocks(batches):
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
            salts = batch.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)[row]
            hashes = words.hashes()
            number, width = words.numbers(hashes), len(words)
            totals = np.bincount(lang)
            yield _counted(langs.dictionary, np.flatnonzero(totals), 0, None, totals[totals > 0])
            for size in range(1, longest + 1):
                at = np.flatnonzero(_runs(words, size))
                at = at[_holds(shared.value, _in_shard(_keys(hashes, salts, size)[at], ANY))]
                if not len(at):
                    continue
                same = lang[at] * width + number[at]
                for k in range(1, size):
                    same = np.unique(same, return_inverse=True)[1] * width + number[at + k]
                _, first, n = np.unique(same, return_index=True, return_counts=True)
                yield _counted(langs.dictionary, lang[at[first]], size, words.texts(at[first], size), n)

    counted = rows.select("lang", "salt", "text").mapInArrow(count, "lang string, words int, phrase string, n bigint")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _counted(langs: pa.Array, lang: np.ndarray, size: int, phrases: list[bytes] | None, n: np.ndarray) -> pa.RecordBatch:
    texts = pa.nulls(len(n), pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string(), safe=False)
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(lang)).cast(pa.string()), pa.array(np.full(len(n), size, np.int32)), texts, pa.array(n.astype(np.int64))],
        names=["lang", "words", "phrase", "n"])


def _small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether the rows and texts of a table prove small enough for a broadcast."""
    texts = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    sized = df.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(ROW_BYTES).cast("bigint"))).alias("bytes")).first()
    return (sized["bytes"] or 0) <= BROADCAST_BYTES and (rows is None or sized["n"] <= rows)


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of which no side is broadcast.

    The planner goes by the size of compressed files, which says little about rows in memory, and behind an explode counts none
    of the rows that come of it.
    """
    return left.join(right.hint("merge"), on, how)


def _joined(left: DataFrame, right: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Broadcast the right side if it proves small, else merge."""
    return left.join(F.broadcast(right), on) if _small(right, rows) else _merged(left, right, on)


def _with_count(cuts: DataFrame, counts: DataFrame, part: str, name: str, small: bool) -> DataFrame:
    """Join the counts of a part of each phrase. Few words are parts of many phrases, so joins that merge are salted."""
    parts = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    if small:
        return cuts.join(F.broadcast(parts), ["lang", part])
    parts = parts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = cuts.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    return _merged(dealt, parts, ["lang", part, "deal"]).drop("deal")


def _words(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def scored(counts: DataFrame, longest: int, broadcast_rows: int | None = None) -> DataFrame:
    """lang, phrase, words, a, l, r, score by the cut that scores lowest; the first of equal ones."""
    phrases = counts.where(F.col("words") >= 2).withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": _words(F.lit(1), F.col("k")), "rest": _words(F.col("k") + 1, F.col("words") - F.col("k"))})
    parts = counts.where(F.col("words").between(1, longest - 1))
    small = _small(parts.select("lang", "phrase"), broadcast_rows)
    cuts = _with_count(_with_count(cuts, parts, "first", "l", small), parts, "rest", "r", small)
    score = F.expr(f"(cast(a AS decimal(19,0)) * {SCALE}) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    best = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def _surroundings(counts: DataFrame) -> DataFrame:
    """For each phrase within a longer one, the largest count of a longer one."""
    longer = counts.where(F.col("words") >= 3)
    inside = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    return inside.groupBy("lang", _words(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS,
                 broadcast_rows: int | None = None) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"),
        F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"))
    rows = rows.select("lang", F.xxhash64("lang").alias("salt"), "shard", "text")
    held = candidates(rows, support, longest)
    counts = phrase_counts(rows, held, longest)
    counts = saved(counts.where(F.col("phrase").isNull() | (F.col("n") >= support)), "phrases")
    phrases = counts.where(F.col("phrase").isNotNull())
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    kept = (_merged(scored(phrases, longest, broadcast_rows), _surroundings(phrases), ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * CONTAINED)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where(F.col("phrase").isNull()).select("lang", "n")
    return _joined(ranked, totals, ["lang"], broadcast_rows).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
