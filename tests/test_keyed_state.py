"""Two-stack sums and waiting rows against brute force, whatever the cuts between batches."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from driftwatch.streaming import keyed


class Counted(dict):
    """A store that counts the parts read."""

    reads = 0

    def __getitem__(self, key):
        self.reads += 1
        return super().__getitem__(key)


def _brute(times, values, counts, size, closed):
    out = []
    for t in times:
        inside = (times > t - size - closed) & (times <= t)
        out.append((values[inside].sum(axis=0), counts[inside].sum(axis=0)))
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("part_rows", [3, 4096])
def test_trailing_sums(monkeypatch, closed, part_rows):
    monkeypatch.setattr(keyed, "PART_ROWS", part_rows)
    draw = random.Random(7 + closed)
    for _ in range(150):
        rows, size = draw.randrange(1, 60), draw.randrange(1, 30)
        times = np.sort(np.array([draw.randrange(draw.choice([5, 40, 400])) for _ in range(rows)], np.int64))
        counts = np.zeros((rows, 2), np.int64)
        counts[np.arange(rows), [draw.randrange(2) for _ in range(rows)]] = [draw.random() < 0.9 for _ in range(rows)]
        values = np.where(counts > 0, np.array([[draw.choice([1.0, 2.5, -4.0, float("nan"), 1e300])] for _ in range(rows)]), 0.0)
        store, numbers, got = {}, {}, []
        starts = sorted({0, *(int(np.searchsorted(times, draw.choice(times.tolist()))) for _ in range(5))})
        for a, b in zip(starts, [*starts[1:], rows]):
            queue = keyed.TrailingSums(store, numbers, 2)
            sums, n = queue.push(times[a:b], values[a:b], counts[a:b], size, closed)
            got += zip(sums, n)
            numbers = __import__("json").loads(__import__("json").dumps(numbers))
        for (s, n), (want, want_n) in zip(got, _brute(times, values, counts, size, closed), strict=True):
            assert np.allclose(s, want, rtol=1e-12, atol=1e-9, equal_nan=True) and (n == want_n).all()
        keyed.TrailingSums(store, numbers, 2).clear()
        assert not store


def test_each_reading_is_read_a_bounded_number_of_times(monkeypatch):
    """A range of 20,000 readings and batches of 100: parts read grow with the readings, not with range times batches."""
    monkeypatch.setattr(keyed, "PART_ROWS", 100)
    store, numbers, one = Counted(), {}, np.ones((100, 1))
    for k in range(1000):
        times = np.arange(100 * k, 100 * k + 100)
        sums, _ = keyed.TrailingSums(store, numbers, 1).push(times, one, one.astype(np.int64), 20_000, False)
        assert sums[-1, 0] == min(100 * k + 100, 20_000)
    assert store.reads < 4 * 1000 and len(store) < 500


def test_infinity_leaves_with_its_reading():
    store, numbers = {}, {}
    x = np.array([[1.0], [float("inf")], [2.0], [3.0]])
    sums, _ = keyed.TrailingSums(store, numbers, 1).push(np.array([0, 1, 5, 9]), x, np.ones((4, 1), np.int64), 4, False)
    assert sums[:, 0].tolist() == [1.0, float("inf"), 2.0, 3.0]


@pytest.mark.parametrize("part_rows", [2, 1024])
def test_waiting_rows(monkeypatch, part_rows):
    monkeypatch.setattr(keyed, "WAITING_ROWS", part_rows)
    draw = random.Random(3)
    store, numbers, seen, watermark, put = {}, {}, [], -1, []
    rows_of = lambda columns: list(zip(columns["ts_us"].tolist(), columns["reading"].tolist()))
    for _ in range(40):
        new = [(draw.randrange(watermark + 1, watermark + 60), draw.random()) for _ in range(draw.randrange(9))]
        put += new
        waiting = keyed.Waiting(store, numbers)
        if new:
            waiting.add(keyed.columns_of([pd.DataFrame(new, columns=["ts_us", "reading"])], ["ts_us", "reading"]))
        watermark += draw.randrange(15)
        due = waiting.due(watermark)
        seen += rows_of(due) if due is not None else []
        assert waiting.earliest() == min((t for t, _ in put if t > watermark), default=None)
    seen += rows_of(keyed.Waiting(store, numbers).due(10**9))
    assert [t for t, _ in seen] == sorted(t for t, _ in put) and sorted(seen) == sorted(put) and not store
