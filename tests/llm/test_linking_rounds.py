"""Rounds of linking go on until every candidate pair that could join classes was verified."""

from __future__ import annotations

from driftwatch.llm import linking


def test_rounds_are_not_bounded(spark, monkeypatch):
    monkeypatch.setattr(linking, "PIVOTS", (1,))
    # Any bound on the rounds ends after the first.
    monkeypatch.setattr(linking, "range", lambda *_: [0], raising=False)
    members = spark.createDataFrame([(7, k) for k in range(6)], "bucket bigint, id bigint")
    roots = linking.classes(linking.saved(members, "members"), lambda pairs: pairs.where("a % 3 = b % 3"))
    assert {r.id: r.root for r in roots.collect()} == {k: k % 3 for k in range(6)}
