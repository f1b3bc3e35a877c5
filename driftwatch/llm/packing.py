"""Best-fit packing of token sequences with a bounded number of open bins.

Every task reads its share of the documents as a stream, turns a text into token ids plus an end id, and places the pieces at
once: a piece goes to the open bin it leaves the least room in. Open bins are found by their free space, one bit of an
integer for each value. If none has room and all bins are in use, the fullest closes. Nothing is shuffled, and a task's
memory is its batch, its open bins and a bounded cache of token ids. Each task may leave open bins unfilled, the fewer the
larger its share.

A document longer than the capacity is cut into pieces of the full length; only its first piece may be shorter.

Defined cases: a null text is empty and consists of the end id. A null id is kept. Repeated rows are packed each. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.tables import text_of

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 256
BATCH_DOCS = 256
CACHED_WORDS = 600_000
CACHED_MARKED = 100_000
CACHED_LENGTH = 48
PARTITION_BITS = 36

_SPACE = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|$)")
# Letters of two alphabets only, so that it is plain which chunks the tokenizer makes of them.
_WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{1,40})([.,:;!?]{1,3})")


class Tokens:
    """Token ids of texts as little-endian 32-bit words.

    A byte-level tokenizer starts a new chunk at a space before a visible character, so the text between two such
    spaces has the same ids wherever it occurs. These stretches are looked up; only new ones are tokenized. A word and
    the marks behind it are chunks of their own and are learned apart. A text that holds the literal of an added token, which
    may take the space beside it, is tokenized whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.literal = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.known: dict[str, bytes] = {}
        self.marked: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, tokenized in one call."""
        if not texts:
            return []
        # Without offsets and word numbers. Byte-level tokens have a character for each byte, so a text ends where its bytes do.
        found = self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        through = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        sizes = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts])
        ends = np.searchsorted(through, sizes, "right") - 1
        if (through[ends] != sizes).any() or ends[-1] != len(ids):  # a vocabulary that does not keep the bytes
            found = self.tokenizer.encode_batch([texts], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(texts)), "right")
        line, edges = ids.tobytes(), [0, *ends.tolist()]
        return [line[4 * start:4 * end] for start, end in zip(edges, edges[1:])]

    def _learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches that are not known, among them those too long to keep."""
        known, marked, marks = self.known, self.marked, self.marks
        if len(known) > CACHED_WORDS:
            known.clear()
        if len(marked) > CACHED_MARKED:
            marked.clear()
            marks.clear()
        found = {s: marked[s] for s in stretches if s in marked}
        matches = [(s, _WORD_AND_MARKS.fullmatch(s)) for s in stretches if s not in found]
        words = {m[1]: known.get(m[1]) for _, m in matches if m}
        new = [w for w, ids in words.items() if ids is None]
        words.update(zip(new, self._encoded([" " + w for w in new])))
        known.update((w, words[w]) for w in new)
        new = list({m[2] for _, m in matches if m and m[2] not in marks})
        marks.update(zip(new, self._encoded(new)))
        joint = {s: words[m[1]] + marks[m[2]] for s, m in matches if m}
        marked.update(joint)
        rest = [s for s, m in matches if not m]
        other = dict(zip(rest, self._encoded([" " + s for s in rest])))
        known.update((s, ids) for s, ids in other.items() if len(s) <= CACHED_LENGTH)
        return found | joint | other

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if self.literal and self.literal.search(t)]
        if not whole:
            return self._by_stretches(texts)
        apart = set(whole)
        found = self._by_stretches(["" if k in apart else t for k, t in enumerate(texts)])
        for k, encoded in zip(whole, self.tokenizer.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
            found[k] = np.array(encoded.ids, "<u4").tobytes()
        return found

    def _by_stretches(self, texts: list[str]) -> list[bytes]:
        get = self.known.get
        split = [_SPACE.split(t) if _ODD_SPACE.search(t) else t.split(" ") for t in texts]
        heads = self._encoded([parts[0] for parts in split])
        found = [[head, *map(get, parts[1:])] for head, parts in zip(heads, split)]
        gaps = [(ids, [k for k, x in enumerate(ids) if x is None], parts) for ids, parts in zip(found, split) if None in ids]
        learned = self._learn(list({parts[k] for _, missing, parts in gaps for k in missing}))
        for ids, missing, parts in gaps:
            for k in missing:
                ids[k] = learned[parts[k]]
        return [b"".join(ids) for ids in found]


_LOADED: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """One vocabulary and cache per Python worker, which is one thread of work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


class OpenBins:
    """Open bins by free space; bit k of `free` tells that some bin has k places left."""

    def __init__(self, capacity: int, limit: int, first: int):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free, self.open = 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.next
            self.next += 1
            if length < space and self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit words), sequence_id, offset.

    vocabulary: a tokenizer file that every executor finds at the same path.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << PARTITION_BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                source, out = [], [[], [], [], [], [], []]
                for row, ids in enumerate(tokens.ids(part.column("text").to_pylist())):
                    ids += end
                    for number, (start, length) in enumerate(pieces(len(ids) // 4, capacity)):
                        source.append(row)
                        values = (number, start, length, ids[4 * start:4 * (start + length)], *bins.place(length))
                        for column, value in zip(out, values):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(source, pa.int64())),
                     *[pa.array(column, kind) for column, kind in zip(out, kinds)]], names=schema.fieldNames())

    return rows.mapInArrow(pack, schema)
