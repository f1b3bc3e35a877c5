"""Repeated passages of more than fifty words that begin and end in the middle of lines and sentences."""

from __future__ import annotations

import random

from driftwatch.llm import substring_dedup


def _prose(rng, count, stops):
    return [rng.choice("abcdefgh") + "".join(rng.choices("ijklmnopq", k=5)) + ("." if stops and k % stops == stops - 1 else "")
            for k in range(count)]


def test_passages_within_lines(spark):
    rng = random.Random(5)
    rows, passages = [], {}
    for k, (length, stops) in enumerate((n, s) for n in (51, 55, 60, 80, 120) for s in (0, 7, 15, 30) for _ in range(6)):
        passage = _prose(rng, length, stops)
        for copy in (0, 1):
            around = [_prose(rng, 40 + rng.randrange(9), 11) for _ in range(2)]
            rows.append((2 * k + copy, " ".join(around[0] + passage + around[1])))
        passages[2 * k + 1] = " ".join(passage)
    rows.append((9000, "word " * 500))
    text = dict(rows)
    covered = {}
    for s in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        covered.setdefault(s.doc_id, []).append((s.start, s.end))
    # Text that repeats itself keeps one whole stretch, and may keep eight words at its end.
    ((start, end),) = covered.pop(9000)
    assert len(text[9000][:start].split()) == 12 and len(text[9000][end:].split()) <= 8
    assert set(covered) == set(passages)
    for doc, passage in passages.items():
        ((start, end),) = covered[doc]
        assert text[doc][start:end] in passage
        assert len(text[doc][start:end].split()) >= len(passage.split()) - 16
