"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are taken on a grid of 64 steps a unit, as whole numbers, so sums and products are exact and do not depend on how rows
are dealt to tasks. The fit list is each distinct vector once. Tasks add up their vectors' differences from the whole part of the
mean and the products of these; Spark adds up the tasks' numbers as decimals, and n^2 times the covariance comes out as whole
numbers. The driver holds one square matrix of the dimension, whatever the number of rows.

The pivoted Cholesky factor L of the scatter has falling rows, and rotations from the right make its columns orthogonal:
L V = U D. The columns' norms squared are the eigenvalues of L L', the normalised columns U its eigenvectors. Pivoting settles the
rank: no component is given beyond it, as it could not be scaled to variance one.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are vectors whose length is not the
commonest among distinct vectors (of equally common ones the longest stays) and empty ones. Entries beyond the grid's 62 bits
are set to its ends. A null id is kept, repeated rows are returned each. A deviation beyond 64 bits is null. A single
distinct vector, or none, has no component and gives no rows, as does an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.tables import saved

STEPS = 64
ORIGIN = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
GRID_END = float(1 << 62)
LIMB = 10 ** 18
EPS = np.finfo(np.float64).eps
SWEEPS = 60


def on_grid(vector: Column) -> Column:
    """Whole numbers x = floor(64 c) + 1000000; null if the vector or an entry of it is null or not finite."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    cell = lambda c: F.greatest(F.least(c.cast("double") * STEPS, F.lit(GRID_END)), F.lit(-GRID_END))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(cell(c)).cast("bigint") + ORIGIN))


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order p with matrix[p][:, p] = L L'; L has as many columns as the matrix has rank."""
    a = matrix.copy()
    size = len(a)
    order, factor = np.arange(size), np.zeros((size, size))
    least = size * EPS * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        best = k + int(np.argmax(a.diagonal()[k:]))
        if not a[best, best] > least:
            return factor[:, :k], order
        for swapped in (a, a.T, factor, order):
            swapped[[k, best]] = swapped[[best, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, falling, and unit directions of the factor's columns after rotations that make them orthogonal."""
    columns = np.ascontiguousarray(factor.T)
    rank = len(columns)
    for _ in range(SWEEPS):
        rotated = False
        for i in range(rank - 1):
            for j in range(i + 1, rank):
                x, y = columns[i], columns[j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= EPS * np.sqrt(xx * yy):
                    continue
                rotated = True
                half = (yy - xx) / (2 * xy)
                tangent = np.copysign(1.0, half) / (abs(half) + np.hypot(1.0, half))
                cosine = 1 / np.hypot(1.0, tangent)
                columns[i], columns[j] = cosine * (x - tangent * y), cosine * (tangent * x + y)
        if not rotated:
            break
    norms = np.sqrt((columns * columns).sum(axis=1))
    falling = np.argsort(-norms, kind="stable")
    return norms[falling], (columns / norms[:, None])[falling].T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and unit eigenvectors as columns, of a positive semidefinite matrix."""
    factor, order = pivoted_cholesky(scatter)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(scatter), 0))
    norms, turned = one_sided_jacobi(factor)
    directions = np.empty_like(turned)
    directions[order] = turned
    return norms ** 2, directions


@dataclass
class Whitening:
    """n, whole part and rest of the mean, sums, unit directions as columns, eigenvalues of the covariance, its trace."""

    n: int
    base: np.ndarray
    rest: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x: rows on the grid."""
        centred = (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        away = x - self.base
        room = (np.abs(away).max(initial=0).item() + 1) * self.n + 1
        if room * room * x.shape[1] < 1 << 63:
            whole = away * self.n - np.array(self.rest, np.int64)
            return (whole * whole).sum(axis=1).tolist()
        whole = away.astype(object) * self.n - np.array(self.rest, object)
        return [d if d < 1 << 63 else None for d in (whole * whole).sum(axis=1).tolist()]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches of (..., x) with their vectors as a matrix of `size` columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(vectors: DataFrame, size: int, numbers: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all vectors of the whole numbers that `numbers` gives for a block (an object array)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, size):
            found = numbers(x)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(total)), pa.int32()), pa.array([t % LIMB for t in total], pa.int64()),
                pa.array([str(t // LIMB) for t in total], pa.string())], names=["k", "low", "high"])

    # A task's totals go in two parts, so that they are not bound to 64 bits nor their sum to 38 digits.
    parts = vectors.select("x").mapInArrow(add, "k int, low bigint, high string")
    exact = [F.sum(F.col(part).cast("decimal(38,0)")).alias(part) for part in ("low", "high")]
    rows = parts.groupBy("k").agg(*exact).collect()
    return [int(row["high"]) * LIMB + int(row["low"]) for row in sorted(rows, key=lambda row: row["k"])]


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Count and sums."""
    if np.abs(x).max(initial=0).item() * len(x) < 1 << 62:
        sums = x.sum(axis=0).tolist()
    else:
        sums = x.astype(object).sum(axis=0).tolist()
    return np.array([len(x), *sums], object)


def _exact_products(base: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of products of differences from the base, for pairs of dimensions i <= j."""

    def numbers(x: np.ndarray) -> np.ndarray:
        y = x - base
        most = np.abs(y).max(initial=0).item()
        if most * most * len(y) < 1 << 53:  # every partial sum is a whole number that a double holds
            y = y.astype(np.float64)
            gram = np.array((y.T @ y)[upper].astype(np.int64).tolist(), object)
        else:
            y = y.astype(object)
            gram = y.T.dot(y)[upper]
        return gram

    return numbers


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct grid vectors x of one length; None if they do not vary."""
    first = vectors.select(F.size("x").alias("size")).limit(1).collect()
    if not first:
        return None
    size = first[0]["size"]
    n, *sums = _summed(vectors, size, _exact_sums)
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    base = np.array(whole, np.int64)
    upper = np.triu_indices(size)
    gram = _summed(vectors, size, _exact_products(base, upper))
    # n times the scatter, that is n^2 times the covariance, in whole numbers.
    exact = [n * g - rest[i] * rest[j] for g, i, j in zip(gram, *(u.tolist() for u in upper))]
    scale = n * n
    covariance = np.zeros((size, size))
    covariance[upper] = [e / scale for e in exact]
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    trace = sum(e for e, i, j in zip(exact, *upper) if i == j) / scale
    values, directions = eigen(covariance)
    if not len(values):
        return None
    return Whitening(n, base, rest, directions[:, :components], values[:components], trace)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the covariance of the whitened fit list minus the identity."""
    count = len(model.values)
    upper = np.triu_indices(count)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for _, x in _blocks(batches, len(shared.value.base)):
            w = shared.value.whitened(x)
            total = total + np.concatenate([w.sum(axis=0), (w.T @ w)[upper]])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "total"])

    rows = vectors.select("x").mapInArrow(add, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    total = np.array([row["total"] for row in sorted(rows, key=lambda row: row["k"])]) / model.n
    mean, products = total[:count], total[count:]
    return float(np.abs(products - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    grid = rows.select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    distinct = saved(grid.select("x").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    schema = T.StructType([
        T.StructField("vec_id", grid.schema["vec_id"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    vectors = distinct.where(F.size("x") == lengths[0]["size"]) if lengths else distinct
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, count = len(model.base), len(model.values)
    error = identity_error(vectors, model)
    explained = model.values / model.trace
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, x in _blocks(batches, size):
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error))], names=schema.fieldNames())

    return grid.where(F.size("x") == size).mapInArrow(project, schema)
