"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, a document the mean of its words, and a
linear softmax turns that into a score. Embeddings and softmax are learned together. Misspelled words share most n-grams
with the words they come from. The model is fitted on a sample of labelled documents bounded by `max_rows` in each class;
every document is scored by its whole text.

Tasks make the bags of the sample where its texts are read, at most BUCKETS entries for a document, and one task learns
from them, so the driver sees only the weights.

Defined cases: null and empty texts have no words and get the score of the bias alone. Labels that are null are ignored;
several labels of one id count by majority, a tie as toxic. Where labelled ids repeat in the documents, the sample holds at
most 2 * max_rows rows, chosen by hash. Without labels of both classes, or without a document of each, the score is
the share of toxic labels, 0 if there are none. A null id is scored as any other. An empty table gives no rows. Other columns are no
inputs and may have any name; `scored` replaces a column that has the name of the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.tables import saved, text_of

MAX_ROWS = 3000
BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
STEPS = 600
RATE = 0.02
DECAY = 1e-6
MIN_DOCS = 10
SCALE = 20.0
BATCH = 64
SEED = 9
MARKS = ".,;:!?\"'()[]{}<>*-_#&%$~…«»„“”‘’"
CACHED_WORDS = 300_000
BASE, GOLDEN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * GOLDEN
    return ((hashes ^ (hashes >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def subwords(chosen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and the number of the word each belongs to: a word with its ends marked, and its n-grams."""
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = [f"<{word}>" for word in chosen]
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(whole)), sizes)
    at = np.arange(len(codes))
    place = (at - (ends - sizes)[owner]).astype(np.uint64)
    spread = (codes + place * GOLDEN) * BASE
    buckets = [_bucket(np.add.reduceat(spread ^ (spread >> np.uint64(31)), ends - sizes))]
    owners = [np.arange(len(whole))]
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # The hash of the n code points from each one on; those that reach into the next word are left out.
        rolled = rolled[:len(codes) - n + 1] * BASE + codes[n - 1:]
        if n in GRAMS:
            inside = at[:len(rolled)] + n <= ends[owner[:len(rolled)]]
            buckets.append(_bucket(rolled[inside] + np.uint64(n)))
            owners.append(owner[:len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def words(text: str) -> list[str]:
    """Stretches between white space; `plain` makes words of them."""
    return text.lower().split()


def plain(stretch: str) -> str:
    return stretch.strip(MARKS)


@dataclass
class Model:
    """What a bucket adds to the log-odds of `toxic`, and the bias."""

    weights: np.ndarray
    bias: float

    def words(self, chosen: list[str]) -> np.ndarray:
        """What each word adds to the sum of a document: the mean over its subwords."""
        buckets, owner = subwords(chosen)
        return np.bincount(owner, self.weights[buckets], len(chosen)) / np.bincount(owner, minlength=len(chosen))

    def score(self, texts: list[str], known: dict[str, float]) -> list[float]:
        """Scores of texts. known: what stretches add, NaN for those without a word; bounded, and extended here."""
        scores = []
        for text in texts:
            if len(known) > CACHED_WORDS:
                known.clear()
            stretches = words(text)
            adds = list(map(known.get, stretches))
            if None in adds:
                new = list({s for s, x in zip(stretches, adds) if x is None})
                plains = [plain(s) for s in new]
                named = [k for k, word in enumerate(plains) if word]
                found = np.full(len(new), np.nan)
                found[named] = self.words([plains[k] for k in named])
                known.update(zip(new, found.tolist()))
                adds = list(map(known.__getitem__, stretches))
            adds = np.array(adds, np.float64)
            adds = adds[~np.isnan(adds)]
            odds = (float(adds.mean()) if len(adds) else 0.0) + self.bias
            scores.append(float(1 / (1 + np.exp(-np.clip(odds, -60, 60)))))
        return scores


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document and their shares: the mean over its words of the mean over their subwords."""
    counts = Counter(w for w in map(plain, words(text)) if w)
    buckets, owner = subwords(list(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    each = (times / max(times.sum(), 1.0) / np.bincount(owner, minlength=len(counts)))[owner]
    found, place = np.unique(buckets, return_inverse=True)
    return found.astype(np.uint16), np.bincount(place, each, len(found)).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], odds: float = 1.0) -> Model:
    """Train embeddings and softmax together, by Adam, with the same number of small batches for any sample. odds: of `toxic` in the data over the sample's."""
    # A bucket that few documents share would only learn those by heart; it stays zero, as one never seen.
    seen = np.bincount(np.concatenate([b for b, _ in bags]), minlength=BUCKETS) if bags else np.zeros(BUCKETS)
    active = seen >= min(MIN_DOCS, len(bags))
    bags = [(b[active[b]], np.float32(SCALE) * w[active[b]]) for b, w in bags]
    random = np.random.default_rng(SEED)
    embedding = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32) * active[:, None]
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    want = np.eye(2, dtype=np.float32)
    parameters = [embedding, softmax, bias]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    step = 0
    while step < STEPS:
        order = random.permutation(len(bags))
        for rows in (order[k:k + BATCH] for k in range(0, len(order), BATCH)):
            step += 1
            if step > STEPS:
                break
            grads = [DECAY * embedding, np.zeros_like(softmax), np.zeros_like(bias)]
            for row in rows:
                buckets, share = bags[row]
                vector = share @ embedding[buckets]
                logits = vector @ softmax + bias
                chance = np.exp(logits - logits.max())
                error = (chance / chance.sum() - want[toxic[row]]) / len(rows)
                grads[0][buckets] += share[:, None] * (softmax @ error)
                grads[1] += np.outer(vector, error)
                grads[2] += error
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parameters[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    toward = SCALE * (softmax[:, 1] - softmax[:, 0])
    return Model((embedding @ toward).astype(np.float32), float(bias[1] - bias[0] + np.log(odds)))


def held_out(doc_id: Column) -> Column:
    """Documents that take no part in training: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model of the labelled documents that are not held out, at most max_rows of each class, chosen by hash."""
    marks = (labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_toxic")))
    shares = {row["_toxic"]: row["count"] for row in marks.groupBy("_toxic").count().collect()}
    if len(shares) < 2:
        toxic = float(shares.get(1, 0) > 0)
        return Model(np.zeros(BUCKETS, np.float32), 50.0 if toxic else -50.0)
    chosen = [marks.where(F.col("_toxic") == k).orderBy(F.xxhash64(F.lit(SEED), "_id")).limit(max_rows) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # At most 2 * max_rows ids and marks are broadcast, whatever the size of the tables.
    sample = rows.join(F.broadcast(chosen), "_id").select(F.xxhash64(F.lit(SEED), "_id", "_text").alias("turn"), "_toxic", "_text")

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                bags = [bag(text.as_py()) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([b[k].tobytes() for b in bags], pa.binary()) for k in (0, 1)]],
                    names=["turn", "toxic", "buckets", "shares"])

    bags = sample.mapInArrow(bagged, "turn bigint, toxic int, buckets binary, shares binary")
    bags = saved(bags.orderBy("turn", "buckets").limit(2 * max_rows), "bags")
    ratio = shares[1] / shares[0]

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
        n = Counter(row[1] for row in rows)
        model = Model(np.zeros(BUCKETS, np.float32), float(np.log(ratio)))
        if len(n) == 2:
            model = fit([(np.frombuffer(b, np.uint16), np.frombuffer(w, np.float32)) for _, _, b, w in rows],
                        [row[1] for row in rows], ratio * n[0] / n[1])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])],
                                         names=["weights", "bias"])

    # A sample bounded by max_rows is learnt from in one task.
    found = bags.coalesce(1).mapInArrow(learnt, "weights binary, bias double").head()
    if found is None:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(ratio)))
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"])


_KNOWN: dict[int, dict[str, float]] = {}


def _known(model: Model) -> dict[str, float]:
    """What a Python worker has learned about stretches under this model; that of another model is dropped."""
    key = hash((model.weights.tobytes(), model.bias))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {}
    return _KNOWN[key]


def _rows_scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """(row, score): each document as a struct, so that its columns may have any name."""
    rows = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                scores = shared.value.score(part.column(1).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(score, schema)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with all their columns and their score between 0 and 1."""
    kept = [F.col("row").getField(name).alias(name) for name in docs.columns if name != score_col]
    return _rows_scored(docs, model, text_col).select(*kept, F.col("score").alias(score_col))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    return _rows_scored(docs, model, text_col).where(F.col("score") < threshold).select("row.*")
