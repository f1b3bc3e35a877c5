"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwatch.llm import (
    bag_minhash, exact_dedup, line_dedup, lz_fingerprint, merkle_audit, mixing, packing, substring_dedup, toxicity, url_filters,
)
from driftwatch.llm.linking import components
from driftwatch.llm.queries import VOCABULARY, damaged
from driftwatch.llm.tables import documents

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b", "s"), (2, None, None), (3, "", "s"), (4, " \n", "t"), (5, "a  b", "t"), (5, "a  b", "t"), (None, "x y", "s"),
       (6, "word " * 6000, "s"), (7, "ab", "s")]
ODD_SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with columns named as the operators name theirs."""
    extra = {"_text": F.lit(1), "size": F.lit(2), "kept": F.lit(3), "id": F.lit(4), "root": F.lit(5), "range": F.lit(6)}
    return spark.createDataFrame(ODD, ODD_SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF).select("doc_id", "text", "source").cache()


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)]
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = _find(parent, a), _find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: _find(parent, n) for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize("limit", [1 << 19, 0])
def test_exact_groups(odd, limit):
    rows = exact_dedup.copy_groups(odd, broadcast_rows=limit).collect()
    found = sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in rows)
    assert found == [(0, None, 1, True), (1, 5, 4, False), (2, 4, 3, False), (3, 4, 3, False), (4, 4, 3, True),
                     (5, 5, 4, False), (5, 5, 4, True), (6, 6, 1, True), (7, 5, 4, False)]
    kept = exact_dedup.without_copies(odd, broadcast_rows=limit)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 5, 6]


def test_apportionment(spark):
    random.seed(3)
    for n, seats in ((5, 17), (20, 900), (3, 1), (4, 0)):
        votes = [round(random.random() * 100, 3) * (k % 4 != 3) for k in range(n)]
        rows = spark.createDataFrame([(k, float(v), seats) for k, v in enumerate(votes)], "k int, votes double, seats bigint")
        got = {r.k: r.quota for r in mixing.highest_quotients(rows, [], "seats", ["k"]).collect()}
        want = [0] * n
        for _ in range(seats):
            want[max(range(n), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert [got[k] for k in range(n)] == want


def test_mixture(docs, odd):
    rows = mixing.mixed(docs).toPandas()
    by = rows.groupby("source", dropna=False).agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"))
    assert (abs(by.k - by.t) <= 64).all() and (rows.taken <= 3 * rows["size"]).all()
    assert (by.t <= 3 * by.s + 1e-6).all() and by.t.sum() == pytest.approx(by.s.sum())
    again = mixing.mixed(docs).toPandas()
    assert sorted(zip(rows.doc_id, rows.taken)) == sorted(zip(again.doc_id, again.taken))
    assert mixing.mixed(odd).count() == len(ODD) and set(mixing.mixture(odd).columns) == set(odd.columns)


def test_near_classes(docs, odd):
    table = docs.orderBy("doc_id").toPandas()
    make = bag_minhash.Shingles()
    bags = [make.of(t) for t in table.text]
    parent = list(range(len(bags)))
    for a in range(len(bags)):
        for b in range(a):
            if bag_minhash.overlap(bags[a], bags[b]) >= 0.8:
                x, y = _find(parent, a), _find(parent, b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in bag_minhash.near_classes(docs).collect()}
    assert got == {d: table.doc_id[_find(parent, k)] for k, d in enumerate(table.doc_id)}
    assert bag_minhash.representatives(docs).count() == len(set(got.values()))
    small = bag_minhash.representatives(odd)
    assert small.columns == odd.columns
    assert Counter(r.doc_id for r in small.collect()) == Counter([1, 2, 3, 4, 6, None, 7])


def test_bag_signature_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    a = (np.sort(rng.integers(1, 1 << 62, 300).astype(np.uint64)), rng.integers(1, 9, 300))
    b = (a[0], np.maximum(a[1] - rng.integers(0, 3, 300), 1))
    x, y = bag_minhash.signatures([a, b])
    assert abs((x == y).mean() - bag_minhash.overlap(a, b)) < 4 * (0.25 / bag_minhash.SLOTS) ** 0.5


def _shingles(line):
    wide = line.encode("utf-16-be")
    return {wide[2 * k:2 * k + 18] for k in range(max(len(wide) // 2 - 9, 0) + 1)}


def test_line_classes(docs, odd):
    first, places = {}, []
    for row in docs.orderBy("doc_id").collect():
        for number, raw in enumerate(row.text.split("\n")):
            line = raw.strip().lower()
            if line:
                first.setdefault(line, (row.doc_id, number))
                places.append(((row.doc_id, number), line))
    lines = list(first)
    sets, holders = [_shingles(line) for line in lines], defaultdict(list)
    for k, found in enumerate(sets):
        for s in found:
            holders[s].append(k)
    parent = list(range(len(lines)))
    for a, b in {(p[i], p[j]) for p in holders.values() for i in range(len(p)) for j in range(i)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = _find(parent, a), _find(parent, b)
            parent[max(x, y)] = min(x, y)
    best = {}
    for k, line in enumerate(lines):
        root = _find(parent, k)
        best[root] = min(best.get(root, first[line]), first[line])
    want = {at: best[_find(parent, lines.index(line))] for at, line in places}
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_classes(docs).collect()}
    assert got == want
    assert line_dedup.line_classes(odd).count() == 6


def test_repeated_spans(spark, odd):
    random.seed(8)
    passage = " ".join("".join(random.choices("abcdefg", k=6)) + (".", "", "", "")[k % 4] for k in range(60))
    other = [" ".join("".join(random.choices("hijklmn", k=6)) for _ in range(80)) + "." for _ in range(3)]
    rows = [(1, f"{other[0]} {passage} end"), (2, f"{other[1]}\n{passage}"), (3, other[2]), (4, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = substring_dedup.repeated_spans(table).collect()
    assert {(s.doc_id, s.keep_doc_id) for s in spans} == {(2, 1)}
    text = dict(rows)
    assert all(text[2][s.start:s.end] in text[1] for s in spans) and sum(s.words for s in spans) >= 50
    cut = {r.doc_id: r.text for r in substring_dedup.cleaned(table).collect()}
    assert cut[1] == text[1] and cut[3] == text[3] and cut[4] is None and passage[40:300] not in cut[2]
    assert substring_dedup.cleaned(odd).columns == odd.columns


def test_fingerprints(docs, odd):
    rows = {r.doc_id: r for r in lz_fingerprint.fingerprints(docs, ranges=7).collect()}
    table = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert len(rows) == len(table)
    for k, (doc, text) in enumerate(table):
        after = table[(k + 1) % len(table)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        own, next_one = lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(after)
        assert rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[doc].fingerprint == own.hex() and rows[doc].near_next == lz_fingerprint.likeness(own, next_one)
        assert rows[doc].edited_fingerprint == lz_fingerprint.fingerprint(edited).hex()
    assert lz_fingerprint.fingerprints(odd).count() == len(ODD)


def test_packing(docs, odd):
    tokens = packing.Tokens(VOCABULARY)
    plain = [t for (t,) in docs.select("text").limit(60).collect()]
    plain += ["", " ", "a  b", " a", "a \n b ", "it's\t 12,3", "x　 y", "<|endoftext|> a", "a?! b. c"]
    whole = tokens.tokenizer.encode_batch(plain, add_special_tokens=False)
    assert tokens.ids(plain) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in whole]
    for table in (docs, odd):
        texts = Counter(r.text or "" for r in table.select("text").collect())
        rows = packing.packed(table, VOCABULARY).collect()
        bins = defaultdict(list)
        for r in rows:
            assert len(r.ids) == 4 * r.length and (r.length == 1024 or r.piece == 0)
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 1024
        assert sum(r.piece == 0 for r in rows) == sum(texts.values())
    total = sum(r.length for r in packing.packed(docs, VOCABULARY).collect())
    count = packing.packed(docs, VOCABULARY).select("sequence_id").distinct().count()
    assert count <= 1.1 * total / 1024 + 1


def test_toxicity(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.1").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    marked = toxicity.scored(docs, model).join(labels, "doc_id").select("toxic", "score", toxicity.held_out(F.col("doc_id")).alias("h"))
    rows = [(r.score, r.toxic) for r in marked.collect() if r.h]
    bad, good = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert sum(b > g for b in bad for g in good) > 0.75 * len(bad) * len(good)
    scores = toxicity.scored(odd, model)
    assert scores.columns == [*odd.columns, "score"] and all(0 <= r.score <= 1 for r in scores.collect())
    assert toxicity.train(odd, labels.limit(0)).bias < 0


def test_urls(spark):
    pages = [(1, "http://a.b.com/x/y", 100), (2, "http://a.b.com/z", 250), (3, "https://U@B.com:80/x", 50), (4, None, 10), (5, "no url", 10)]
    lists = [("b.com", "block", 60), ("a.b.com", "allow", 200), ("b.com", "unlist", 300), ("a.b.com/x", "block", 90), (None, "block", 1)]
    rows = url_filters.judged(spark.createDataFrame(pages, "page_id int, url string, fetched_at bigint"),
                              spark.createDataFrame(lists, "pattern string, action string, listed_at bigint")).collect()
    assert {r.page_id: (r.verdict, r.pattern) for r in rows} == {
        1: ("drop", "a.b.com/x"), 2: ("keep", "a.b.com"), 3: ("keep", None), 4: ("keep", None), 5: ("keep", None)}


def test_merkle(spark):
    records = merkle_audit.archived(spark.read.parquet(f"{SF}/pages.parquet"))
    copy = damaged(records)
    got = {(r.file, r.offset): r.state for r in merkle_audit.audit(records, copy).collect()}
    a = {(r.file, r.offset): r.record for r in records.collect()}
    b = {(r.file, r.offset): r.record for r in copy.collect()}
    assert got == {k: "altered" if k in b else "missing" for k in a if b.get(k) != a[k]}
    assert merkle_audit.audit(records, records).count() == 0
    assert merkle_audit.audit(records.limit(0), records).where("state = 'extra'").count() == len(a)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    frames = [exact_dedup.copy_groups(none), exact_dedup.without_copies(none), mixing.mixed(none), mixing.mixture(none),
              bag_minhash.near_classes(none), line_dedup.line_classes(none), substring_dedup.repeated_spans(none),
              lz_fingerprint.fingerprints(none), packing.packed(none, VOCABULARY)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark):
    docs, sf_dir = documents(spark, SF), SF
    names = docs.columns
    left = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    unique = corpus_pipeline.drop_copies(spark, left, sf_dir)
    keys = {"".join(c for c in r.text if c not in " \t\n\x0b\x0c\r") for r in left.collect()}
    assert left.columns == names and unique.count() == len(keys)
    apart = corpus_pipeline.drop_near_copies(spark, unique, sf_dir)
    mixed = corpus_pipeline.mix_sources(spark, apart, sf_dir)
    assert apart.columns == names and mixed.columns == names
    pieces = corpus_pipeline.pack(spark, mixed, sf_dir)
    assert pieces.where("piece = 0").count() == mixed.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
