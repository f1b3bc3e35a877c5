"""Trailing alerts with reset on infinite readings, spikes and repeated stamps."""

from __future__ import annotations

import numpy as np

from driftwatch.operators.resets import _RangeMeans, trailing_reset_step

SECOND = 1_000_000


def step_rows(readings: list[tuple[int, int, float]]) -> dict[str, np.ndarray]:
    """(second, channel, reading) as the rows of one motor."""
    ts, channel, x = (np.array(c) for c in zip(*readings))
    ts = ts.astype(np.int64) * SECOND
    return {"position": (ts << 3) | channel, "ts_us": ts, "channel": channel, "reading": x.astype(float),
            "fresh": np.ones(len(ts), bool)}


HEALTHY = (300.0, 310.0, 1500.0, 40.0)


def healthy(seconds: int) -> list[tuple[int, int, float]]:
    return [(second, k, HEALTHY[k]) for second in range(1, seconds + 1) for k in range(4)]


def test_ranges_equal_their_own_means():
    rng = np.random.default_rng(5)
    x = rng.normal(size=301)
    x[[17, 40, 200]] = np.inf, 1e20, np.nan
    mask = rng.random(301) < 0.6
    mask[[17, 40, 200]] = True
    begin = rng.integers(0, 302, 500)
    end = np.maximum(begin, rng.integers(0, 302, 500))
    mean, n = _RangeMeans(mask, x).over(begin, end)
    for b, e, m, count in zip(begin, end, mean, n):
        held = x[b:e][mask[b:e]]
        assert count == len(held)
        if count:
            assert np.isclose(m, held.mean(), rtol=1e-9, equal_nan=True)


def test_an_infinite_reading_leaves_later_ranges_alone():
    rows = healthy(400)
    rows[50 * 4 + 2] = (51, 2, np.inf)
    found = trailing_reset_step(step_rows(rows), SECOND << 2, 40 * SECOND, SECOND * 10**9)
    seconds = [int(p) // (SECOND << 3) for p in found["position"]]
    assert seconds and all(51 <= s < 91 for s in seconds)


def test_a_spike_leaves_later_ranges_alone():
    rows = healthy(400)
    rows[50 * 4 + 3] = (51, 3, 1e20)
    found = trailing_reset_step(step_rows(rows), SECOND << 2, 40 * SECOND, SECOND * 10**9)
    assert all(51 <= int(p) // (SECOND << 3) < 91 for p in found["position"])


def test_a_repeat_of_the_alerting_reading_counts_after_the_alert():
    """Power is far too low at any time, so each complete set of four readings alerts."""
    rows = [(1, 0, 300.0), (2, 1, 310.0), (3, 2, 1.0), (4, 3, 1.0), (4, 3, 1.0), (6, 0, 300.0), (7, 1, 310.0), (8, 2, 1.0)]
    found = trailing_reset_step(step_rows(rows), 0, 100 * SECOND, SECOND)
    assert [int(p) // (SECOND << 3) for p in found["position"]] == [4, 8]
