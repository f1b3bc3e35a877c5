"""The tagger reads few characters twice, keeps every span shorter than the overlap whole, and the lessons are read once."""

from __future__ import annotations

import numpy as np

from driftwatch.llm import pii


def test_few_characters_are_read_twice():
    text = "plain words " * 1000
    assert len(pii.windows(text)) * pii.WINDOW <= 1.4 * len(text)


def test_short_spans_lie_inside_a_window():
    text = "x" * 2000
    starts = pii.windows(text)
    for start in range(1, len(text) - 49):
        end = start + 47
        assert any((at < start or at == 0) and (end < at + pii.WINDOW or at + pii.WINDOW >= len(text)) for at in starts)


def test_states_of_long_windows_and_of_large_inputs():
    tagger = pii.Tagger(3)
    tagger.p["inward"] = tagger.p["inward"] * 200
    x = np.random.default_rng(1).integers(0, pii.CODES, (20, pii.WINDOW))
    hidden = tagger._hidden(x)
    assert np.isfinite(hidden).all() and np.allclose(hidden.transpose(0, 2, 1), tagger.states(x), atol=1e-4)


def test_lessons_are_read_once(spark, tmp_path, monkeypatch):
    """One pass over the documents serves all three sorts of windows."""
    calls = spark.sparkContext.accumulator(0)
    real = pii.lessons

    def counted(text):
        calls.add(1)
        return real(text)

    monkeypatch.setattr(pii, "lessons", counted)
    docs = spark.createDataFrame([(k, f"row {k} plain words") for k in range(40)], "doc_id long, text string")
    assert pii.train(docs) is None
    assert calls.value == sum(not pii.held_out(k) for k in range(40))
