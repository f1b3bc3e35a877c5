"""Operators that return documents keep every column, whatever it is called, and copies come out as often as counted."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwatch.llm import bag_minhash, exact_dedup, linking, mixing, substring_dedup

NAMES = ["_id", "_tie", "_spans", "_twice", "twice", "row", "_row", "doc", "digest", "_own", "_key", "_times", "_rows", "taken", "score",
         "_digest", "_open", "_full", "tie", "turn"]
LINE = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, f"first {LINE} end", "s"), (2, f"second {LINE} other", "s"), (3, None, "t"), (4, "", None), (None, "short text", "t"),
            (5, LINE, "s"), (5, LINE, "s"), (6, LINE + " x", "t")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: F.lit(7) for n in NAMES})


@pytest.mark.parametrize("keep", [bag_minhash.representatives, exact_dedup.without_copies, substring_dedup.cleaned, mixing.mixture])
def test_columns_stay(clashing, keep):
    out = keep(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[n] == 7 for r in rows for n in NAMES)
    assert keep(clashing.limit(0)).count() == 0


def test_representatives_and_cuts(clashing):
    kept = Counter(r.doc_id for r in bag_minhash.representatives(clashing).collect())
    assert kept == {1: 1, 3: 1, 4: 1, None: 1}
    cut = {(r.doc_id, r.text) for r in substring_dedup.cleaned(clashing).collect()}
    assert (1, f"first {LINE} end") in cut and (3, None) in cut and (4, "") in cut
    assert all("word30" not in text for doc, text in cut if doc == 2)


def test_mixture_counts_copies_of_equal_rows(spark):
    rows = [(k, f"a{k} " * (k % 7 + 1), "s") for k in range(40)] + [(50, "twice the same row", "s")] * 2 + [(60, "", "t"), (60, "", "t"), (61, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = Counter()
    sizes = {}
    for r in mixing.mixed(docs).collect():
        taken[r.doc_id] += r.taken
        sizes[r.doc_id] = r.size
    want = {doc: round(taken[doc] / size + 1e-9) for doc, size in sizes.items() if size}
    got = Counter(r.doc_id for r in mixing.mixture(docs).collect())
    assert got == {**{doc: n for doc, n in want.items() if n}, 60: 2, 61: 1}


@pytest.mark.parametrize("many", [0, 1 << 40])
def test_nearest_pivots_first_give_the_same_classes(spark, monkeypatch, many):
    monkeypatch.setattr(linking, "MANY_PAIRS", many)
    random.seed(11)
    base = [random.getrandbits(63) for _ in range(3)]
    marks = [base[k % 3] ^ sum(1 << b for b in random.sample(range(63), k % 9)) for k in range(45)]
    members = spark.createDataFrame([(k % 2, i) for i, k in enumerate(range(45))] + [(5, i) for i in range(0, 45, 4)], "bucket bigint, id bigint")
    sketches = spark.createDataFrame([(i, (m,)) for i, m in enumerate(marks)], "id bigint, sketch struct<`0_0`:bigint>")
    marked = sketches.select("id", F.col("sketch").getField("0_0").alias("mark"))

    def verify(pairs):
        left, right = marked.toDF("a", "x"), marked.toDF("b", "y")
        return pairs.join(left, "a").join(right, "b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 6).select("a", "b")

    roots = {r.id: r.root for r in linking.classes(linking.saved(members, "members"), verify, sketches, 20).collect()}
    of = {}
    for r in members.collect():
        of.setdefault(r.bucket, []).append(r.id)
    parent = list(range(45))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in of.values():
        for a in ids:
            for b in ids:
                if (marks[a] ^ marks[b]).bit_count() <= 6:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert [roots.get(i, i) for i in range(45)] == [find(i) for i in range(45)]
