"""Patterns against backtracking expressions, gradients by differences, held-out spans, and windows against whole texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from driftwatch.llm import pii
from driftwatch.llm.tables import documents

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
SF = "/root/testdata/sf0.1"


def _passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == 1:
        return all(int(part) <= 255 for part in text.split("."))
    if kind == 2:
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def _brute(text):
    return sorted((m.start(), kind, m.end()) for kind, pattern in enumerate(PATTERNS)
                  for m in re.finditer(pattern, text) if _passes(kind, m[0]))


def _line(spans):
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans():
    draw = random.Random(1)
    for _ in range(30_000):
        text = "".join(draw.choice("aB01234567890.. @@-+ (é") for _ in range(draw.randrange(48)))
        assert pii.base_spans(text) == _brute(text)
    assert pii.base_spans("4539 1488 0343 6467, +1 (017) 555-7713 a.b@c.d.e@f.g 1.2.3.4.5") == _brute(
        "4539 1488 0343 6467, +1 (017) 555-7713 a.b@c.d.e@f.g 1.2.3.4.5")


def test_long_texts_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 300_000 + " x@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "+1" + " " * 300_000, "a@" * 150_000):
        pii.base_spans(text)
    assert time.perf_counter() - start < 5


def test_gradients():
    draw = np.random.default_rng(0)
    tagger = pii.Tagger(3, np.float64)
    x, y = draw.integers(0, pii.CODES, (3, 11)), np.zeros((3, 11), int)
    y[0, 2:5], y[1, 0:3], y[2, 9:11] = [1, 2, 2], [4, 4, 4], [5, 6]
    _, grads = tagger.loss(x, y)
    for name, p in tagger.p.items():
        places = [(x[0, 3], 1), (x[2, 5], 4)] if name == "embedding" else [tuple(draw.integers(0, n) for n in p.shape) for _ in range(6)]
        for at in places:
            if name == "follow" and not pii.ALLOWED[at]:
                continue
            kept, sides = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = kept + step
                sides.append(tagger.loss(x, y)[0])
            p[at] = kept
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_likelihood_and_best_path_against_all_paths():
    """On four characters all 9^4 paths can be listed."""
    import itertools

    tagger = pii.Tagger(5, np.float64)
    x = np.array([[3, 1, 1, 40]])
    level = tagger.emissions(x)[:, 0]
    follow = np.where(pii.ALLOWED, tagger.p["follow"], pii.NEVER)
    score = lambda path: (tagger.p["first"][path[0]] + sum(level[t, k] for t, k in enumerate(path))
                          + sum(follow[a, b] for a, b in zip(path, path[1:])))
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    scores = np.array([score(p) for p in paths])
    want = np.log(np.exp(scores - scores.max()).sum()) + scores.max()
    assert tagger.loss(x, np.array([[0, 1, 2, 0]]))[0] == pytest.approx(want - score((0, 1, 2, 0)), abs=1e-8)
    assert tuple(tagger.decoded(x)[0][0]) == paths[int(scores.argmax())]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(documents(spark, SF))


def test_held_out_windows(spark, model):
    """Spans of windows of documents that took no part in training, as written and rewritten by hand."""
    rows = documents(spark, SF).where("text RLIKE '[0-9@]'").select("doc_id", "text").collect()
    held = sorted({(text, line) for r in rows if pii.held_out(r.doc_id) for sort, text, line in pii.lessons(r.text) if sort == 0})
    assert len(held) > 100
    for share in (0.0, 1.0):
        x, y = pii.lesson_arrays(held, share=share, seed=4)
        paths, _ = model.decoded(x)
        found, want = ([set(pii._path_spans(line)) for line in lines] for lines in (paths, y))
        hits = sum(len(a & b) for a, b in zip(found, want))
        assert hits / sum(map(len, found)) > 0.85 and hits / sum(map(len, want)) > 0.7


def test_windows_without_digits_give_nothing(model, monkeypatch):
    """Tagging every window gives what tagging those with a digit or an at-sign gives."""
    texts = ["plain words " * 40, "", "x" * 50, ("write jo.hn34 (at) mail7.example.com or 10[.]2[.]3[.]4 now, " + "then rest of it all " * 9) * 3,
             "call (017) 555-7713 " + "a b c " * 40 + "12@x.yz"]
    few = pii.tagged(texts, model)
    every = lambda text: list(range(0, max(-(-(len(text) - pii.WINDOW) // pii.STRIDE), 0) * pii.STRIDE + 1, pii.STRIDE))
    monkeypatch.setattr(pii, "windows", every)
    assert pii.tagged(texts, model) == few
    assert any(len(spans) > len(base) for base, spans in few)
    for text, (base, spans) in zip(texts, few):
        assert set(base) <= set(spans) and base == _brute(text)


def test_reconciled():
    text = "1" * 10 + " 10[.]2[.]3[.]4 (017) 555-7713 "
    ip, phone, part = (11, pii.IP, 25), (26, pii.PHONE, 40), (26, pii.PHONE, 36)
    assert pii.reconciled(text, [], [(ip, 5.0), (ip, 4.0), (phone, 3.0), (part, 2.5)]) == [ip, phone]
    assert pii.reconciled(text, [(20, pii.CARD, 30)], [(ip, 5.0), (phone, 3.0)]) == [(20, pii.CARD, 30)]
    assert pii.reconciled(text, [], [(ip, 1.0)]) == []


def test_odd_rows(spark, model):
    text = "é a1@b.cd, 10.0.0.1 and 4539148803436467 or +1 (017) 555-7713"
    rows = [(1, text), (2, None), (3, ""), (None, text), (1, text), (4, "x " * 60_000 + "10.0.0.1")]
    table = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, spans string, base int")
    for tagger in (model, None):
        got = pii.personal_data(table, tagger).collect()
        assert sorted((r.doc_id or 0, r.base) for r in got) == sorted((i or 0, _line(_brute(t or ""))) for i, t in rows)
        for r in got:
            assert r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest()
            assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [r.base.count(k) for k in ("email", "ip", "card", "phone")]
    assert pii.personal_data(table.limit(0), model).count() == 0
    assert pii.train(table) is None and pii.train(table.limit(0)) is None
