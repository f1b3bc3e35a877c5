"""Whitening against exact fractions and numpy's eigenvalues, on vectors of every odd kind."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x int, component string, n int"


def _brute(rows):
    """Sums, covariance and deviations in fractions, from (id, vector) rows."""
    grid = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in grid})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(size)]
    centred = [[Fraction(x[k] * n - sums[k], n) for k in range(size)] for x in fit]
    covariance = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(size)] for i in range(size)])
    deviations = sorted((i is None, i or 0, sum((n * x[k] - sums[k]) ** 2 for k in range(size))) for i, x in grid)
    return n, covariance, deviations, grid, sums


@pytest.mark.parametrize("shift", [0.0, 3e4])
def test_against_fractions(spark, shift):
    random = np.random.default_rng(5)
    base = random.normal(0, 1, (60, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) + shift
    rows = [(k, base[k].astype(np.float32).tolist()) for k in range(60)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, rows[9][1])]
    odd = [(1000, None), (1001, [None] + [0.0] * 5), (1002, [float("nan")] + [0.0] * 5), (1003, [float("inf")] + [0.0] * 5),
           (1004, []), (1005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows + odd], SCHEMA).repartition(5)
    got = whitening.whitened(table).collect()
    n, covariance, deviations, grid, sums = _brute(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * 6 and {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == deviations
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    explained = {r.component: r.explained for r in got}
    assert [explained[k] for k in range(1, 7)] == pytest.approx((values / values.sum()).tolist(), rel=1e-10)
    want = (np.array([[x - s / n for x, s in zip(v, sums)] for _, v in grid]) @ vectors) / np.sqrt(values)
    by_id = {}
    for (i, _), w in zip(grid, want):
        by_id[i] = w
    for k in range(6):
        mine = [(r.vec_id, r.whitened) for r in got if r.component == k + 1]
        sign = np.sign(sum(w * by_id[i][k] for i, w in mine))
        assert all(abs(w - sign * by_id[i][k]) < 1e-6 for i, w in mine)


def test_low_rank_and_scale():
    random = np.random.default_rng(2)
    tall = random.normal(0, 1, (20, 4)) * [1e3, 1, 1e-3, 1e-9]
    values, vectors = whitening.eigen(tall @ tall.T)
    want = np.linalg.svd(tall, compute_uv=False) ** 2
    assert len(values) <= 4 and values[:2] == pytest.approx(want[:2], rel=1e-8)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    equal, turned = whitening.eigen(np.eye(5) * 3.0)
    assert equal.tolist() == pytest.approx([3.0] * 5) and np.abs(turned.T @ turned - np.eye(5)).max() < 1e-12
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def test_few_components_and_rank(spark):
    """Three dimensions of which one repeats another: two components, whatever the number asked for."""
    rows = [(k, [float(a), float(b), float(a)], 0, "", 0) for k, (a, b) in enumerate([(0, 0), (1, 0), (0, 2), (5, 1), (5, 1)])]
    table = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whitened(table).collect()
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert {r.component for r in whitening.whitened(table, components=1).collect()} == {1}


def test_degenerate_tables(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 0, "", 0), (2, [1.0, 2.0], 0, "", 0)], SCHEMA)
    assert whitening.whitened(table).count() == 0
    assert whitening.whitened(table.limit(0)).count() == 0
    assert whitening.whitened(table.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_huge_entries(spark):
    """Products beyond 64 bits stay exact; a deviation beyond 64 bits is null."""
    rows = [(k, [v, 1.0]) for k, v in enumerate([1e12, -1e12, 3e12, 0.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA.replace("float", "double"))).collect()
    assert {r.component for r in got} == {1} and {r.deviation for r in got} == {None}
    far = spark.createDataFrame([(1, [1e300], 0, "", 0), (2, [-1e300], 0, "", 0)], SCHEMA.replace("float", "double"))
    assert sorted(round(r.whitened, 6) for r in whitening.whitened(far).collect()) == [-1, 1]
