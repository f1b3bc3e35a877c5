"""Subword bags, scores and the training task against plain Python, and documents with clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwatch.llm import toxicity

WORDS = ["ab", "a", "hello", "éeuxier", "hello", "𝒳yz", "hallo"]


def by_hand(word: str) -> list[tuple]:
    whole = f"<{word}>"
    return [("whole", whole)] + [(n, whole[i:i + n]) for n in toxicity.GRAMS for i in range(len(whole) - n + 1)]


def test_subwords_are_functions_of_their_grams():
    buckets, owner = toxicity.subwords(WORDS)
    bucket_of: dict[tuple, int] = {}
    for k, word in enumerate(WORDS):
        alone, _ = toxicity.subwords([word])
        assert sorted(buckets[owner == k]) == sorted(alone)
        assert len(alone) == len(by_hand(word))
        ordered = sorted(by_hand(word), key=lambda g: (g[0] != "whole", g[0] if g[0] != "whole" else 0))
        for gram, bucket in zip(ordered, alone.tolist()):
            assert bucket_of.setdefault(gram, bucket) == bucket
    assert len(set(bucket_of.values())) > 0.9 * len(bucket_of)


def test_score_is_the_mean_of_words():
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(weights, 0.25)

    def word(w):
        return float(weights[toxicity.subwords([w])[0]].astype(np.float64).mean())

    odds = (2 * word("hello") + word("ab") + word("x")) / 4 + 0.25
    want = [1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(-0.25)), 1 / (1 + np.exp(-0.25))]
    known: dict[str, float] = {}
    texts = ["Hello, (AB)  hello!\n-- x", "", "... --"]
    assert model.score(texts, known) == pytest.approx(want, abs=1e-9)
    assert model.score(texts, known) == model.score(texts, {})
    buckets, shares = toxicity.bag(texts[0])
    assert float(shares @ weights[buckets]) + 0.25 == pytest.approx(odds, abs=1e-5)


def test_unseen_misspellings_share_weights():
    bad, good = ["you idiot go away", "what an idiot", "idiot idiot", "such idiots"], ["a nice day", "the weather is fine", "good morning", "nice work"]
    bags = [toxicity.bag(t) for t in bad * 5 + good * 5]
    model = toxicity.fit(bags, [1] * 20 + [0] * 20)
    scores = model.score(["idiott", "nicely", "an idiooot"], {})
    assert scores[0] > 0.5 > scores[1] and scores[2] > scores[1]


def test_clashing_names_null_ids_and_empty_tables(spark, sf_dir):
    rows = [(1, "you idiot", 0.5, 1, "r"), (None, None, 0.25, 2, "s"), (3, "", None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, _toxicity int, row string")
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    found = toxicity.scored(docs, model)
    assert sorted(found.columns) == sorted(docs.columns)
    assert {round(r.score, 6) for r in found.collect()} == {round(1 / (1 + np.e), 6)}
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert toxicity.without_toxic(docs, toxicity.Model(model.weights, 1.0)).count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0
    left = corpus_pipeline.drop_toxic(spark, docs.where("doc_id IS NULL"), sf_dir)
    assert left.columns == docs.columns and left.count() <= 1


def test_training_reads_ids_that_repeat_up_to_the_bound(spark):
    docs = spark.createDataFrame([(k % 6, f"idiot number {k}" if k % 2 else f"fine day {k}") for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(7, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, max_rows=20)
    scores = model.score(["idiot", "fine day"], {})
    assert scores[0] > scores[1]
    assert np.array_equal(model.weights, toxicity.train(docs.repartition(7), labels, max_rows=20).weights)
    held = {r.doc_id for r in labels.where(toxicity.held_out(F.col("doc_id"))).collect()}
    none = toxicity.train(docs.limit(0), labels.where(~F.col("doc_id").isin(*held)) if held else labels)
    assert not none.weights.any()
