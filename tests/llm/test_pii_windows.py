"""The tagger reads every window of a text, whatever characters it holds."""

from __future__ import annotations

import numpy as np

from driftwatch.llm import pii


class Marks(pii.Tagger):
    """Tags the characters of one word as an address; the rest is outside."""

    word = "mary.jones(at)harbour.example.com"

    def decoded(self, x):
        code, paths = pii.codes(self.word), np.zeros(x.shape, np.int64)
        for row in range(len(x)):
            for at in range(x.shape[1] - len(code) + 1):
                if (x[row, at:at + len(code)] == code).all():
                    paths[row, at:at + len(code)] = pii.tags(len(code), [(0, pii.EMAIL, len(code))])
        level = np.zeros((x.shape[1], len(x), pii.TAGS), np.float32)
        level[:, :, 1:] = 1
        return paths, level


def test_address_without_digit_or_at_sign():
    text = "some plain words about it " * 9 + "write to " + Marks.word + " soon" + " and more of them" * 9
    start = text.index(Marks.word)
    assert pii.tagged([text, "plain " * 30], Marks()) == [([], [(start, pii.EMAIL, start + len(Marks.word))]), ([], [])]


def test_windows_cover_texts():
    for length in (0, 1, 95, 96, 97, 144, 145, 1000):
        seen = {at for start in pii.windows("x" * length) for at in range(start, start + pii.WINDOW)}
        assert set(range(length)) <= seen
    texts = ["x" * 700, "", "é 1", "ab" * 30_000]
    coded = [(place, row.copy()) for places, x in pii._coded(texts) for place, row in zip(places, x)]
    assert [place for place, _ in coded] == [(k, at) for k, text in enumerate(texts) for at in pii.windows(text)]
    for (k, at), row in coded:
        piece = pii.codes(texts[k][at:at + pii.WINDOW])
        assert (row[:len(piece)] == piece).all() and (row[len(piece):] == pii.PAD).all()


def test_paths_of_all_windows():
    """Only windows whose best path holds a span are traced back; the paths are those of tracing all."""
    draw, tagger = np.random.default_rng(2), pii.Tagger(4)
    tagger.p["level"][0] = 1.5
    x = draw.integers(0, pii.CODES, (300, 30))
    paths, level = tagger.decoded(x)
    assert (paths == tagger._best_paths(level)).all() and 0 < paths.any(axis=1).sum() < 300
    assert np.allclose(level, tagger.states(x) @ tagger.p["outward"] + tagger.p["level"], atol=1e-5)
