"""Collocations against counting every phrase in plain Python on odd texts, small blocks, full filters and salted joins."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftwatch.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, words int"


def _brute(rows, support, longest=4, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[at:at + size])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1))
                         for q, b in frequent.items())
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _rows(seed, count):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "Élan", "x y", "new york", "san  francisco bay", "big\tdata", "\x00", "ÀB", "in", "to"]
    rows = []
    for k in range(count):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?", " - "])
                       for _ in range(draw.randrange(60)))
        rows.append((k, text, draw.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [(None, None, None), (3, "", "en"), (3, "new york " * 40, "de"), (5, ".,;", "en"), (5, "the of a " * 900, "fr")] * 2


def _table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2) for i, t, g in rows], SCHEMA).repartition(3)


def _found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit, shards, top", [(None, 4, 2000), (0, 7, 5)])
def test_against_brute_force(spark, limit, shards, top):
    rows = _rows(3, 300)
    got = collocations.collocations(_table(spark, rows), support=12, shards=shards, top=top, broadcast_rows=limit)
    assert _found(got) == _brute(rows, 12, top=top)


def test_full_filters(spark, monkeypatch):
    """Filters so small that everything seems to be held give the same."""
    rows = _rows(8, 120)
    want = _brute(rows, 6, longest=3)
    fill = collocations._filter
    monkeypatch.setattr(collocations, "_filter", lambda keys, bits=64, parts=2: fill(keys, bits, parts))
    assert _found(collocations.collocations(_table(spark, rows), support=6, longest=3)) == want


def test_words_of_blocks():
    texts = ["", "a b. C", "", "d  e\tf", "", "ü" * 50 + " g.h i j k. l m " * 9, "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array(["zz", *texts, "zz"])], names=["k", "text"])
    whole = [(k, [(w, j) for piece in re.split("[.]", t.lower()) for j, w in enumerate(re.findall("[^ \t]+", piece))])
             for k, t in enumerate(texts)]
    want = [(k, w.encode(), j > 0) for k, words in whole for w, j in words]
    for size in (1, 7, 30, 1 << 20):
        got = []
        for part, row, words in collocations._blocks(iter([batch.slice(1, len(texts))]), size):
            follows = np.concatenate(([False], words.joined))
            raw = words.data.tobytes()
            got += [(int(r), raw[s:e], bool(f)) for r, s, e, f in zip(row, words.start, words.end, follows)]
        assert got == want, size


def test_words_that_share_a_hash_stay_apart():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    words = collocations.Words(data, np.array([len(data)]))
    number = words.numbers(np.zeros(4, np.uint64))
    assert number[0] == number[2] and len(set(number.tolist())) == 3
    assert words.texts(np.array([0, 1]), 2) == [b"ab cd", b"cd ab"]


def test_products_beyond_64_bits(spark):
    big = 8_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)],
                                   "lang string, words int, phrase string, n bigint")
    row = collocations.scored(counts, 4).collect()[0]
    assert row.score == 2_000_000 * (big - 2) // (2 * big - 1)


def test_empty(spark):
    table = _table(spark, _rows(1, 5))
    assert collocations.collocations(table.limit(0)).count() == 0
    assert collocations.collocations(table, support=10**6).count() == 0
