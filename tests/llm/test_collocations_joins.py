"""Counts of phrases are broadcast only if they prove small in memory, whatever the size of their files."""

from __future__ import annotations

import pytest

from driftwatch.llm import collocations

SCHEMA = "lang string, words int, phrase string, n bigint"


def _counts(spark, tmp_path, word=""):
    rows = [("en", 1, f"a{word}{k}", 90 + k) for k in range(40)]
    rows += [("en", 2, f"a{word}{k} a{word}{(k + d) % 40}", 40 + k) for k in range(40) for d in (1, 3)]
    path = str(tmp_path / "counts")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def _want(counts):
    n = {r.phrase: r.n for r in counts.collect()}
    return sorted((p, a, n[p.split()[0]], n[p.split()[1]], 2_000_000 * a // (n[p.split()[0]] + n[p.split()[1]]))
                  for p, a in n.items() if " " in p)


@pytest.mark.parametrize("limit, most, word", [(0, 8 << 20, ""), (None, 5000, ""), (None, 100_000, "x" * 5000)])
def test_no_broadcast_beyond_the_limit(spark, tmp_path, monkeypatch, limit, most, word):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", most, raising=False)
    counts = _counts(spark, tmp_path, word)
    out = collocations.scored(counts, 4, limit)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.phrase, r.a, r.l, r.r, r.score) for r in out.collect()) == _want(counts)


def test_broadcast_of_small_counts(spark, tmp_path):
    counts = _counts(spark, tmp_path)
    out = collocations.scored(counts, 4)
    assert "BroadcastExchange" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.phrase, r.a, r.l, r.r, r.score) for r in out.collect()) == _want(counts)
