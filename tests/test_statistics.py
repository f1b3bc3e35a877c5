"""The t distribution, pairing and verdicts on small samples."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from driftwatch.functions.student_t import upper_tail
from driftwatch.operators.comparison import paired_differences, paired_t_test, verdicts
from driftwatch.schemas import BASELINE_MODEL, CANDIDATE_MODEL

# Tabulated upper 5% and 0.5% points.
TABLE = {1: (6.3138, 63.657), 2: (2.9200, 9.9248), 5: (2.0150, 4.0321), 9: (1.8331, 3.2498), 30: (1.6973, 2.7500), 120: (1.6577, 2.6174)}


def _tails(spark, pairs):
    df = spark.createDataFrame(pairs, "t double, df long")
    return [r[0] for r in df.select(upper_tail(F.col("t"), F.col("df"))).collect()]


def test_tabulated_points(spark):
    pairs = [(t, df) for df, points in TABLE.items() for t in points]
    for p, expected in zip(_tails(spark, pairs), [0.05, 0.005] * len(TABLE)):
        assert p == pytest.approx(expected, rel=2e-4)


def test_symmetry(spark):
    pairs = [(t, df) for t in (0.0, 0.3, 1.7, 5.0) for df in (1, 2, 3, 8, 41, 5000)]
    up, down = _tails(spark, pairs), _tails(spark, [(-t, df) for t, df in pairs])
    assert all(a + b == pytest.approx(1.0, abs=1e-14) for a, b in zip(up, down))


def _integrated(t, df, steps=40_000):
    """Simpson's rule over the density, for comparison only."""
    log_scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(df * math.pi) / 2
    density = [math.exp(log_scale - (df + 1) / 2 * math.log1p((t * i / steps) ** 2 / df)) for i in range(steps + 1)]
    return 0.5 - t / steps / 3 * (density[0] + density[-1] + 4 * sum(density[1:-1:2]) + 2 * sum(density[2:-1:2]))


def _exact(t, df):
    """The finite trigonometric series, for up to a few thousand degrees."""
    angle = math.atan(t / math.sqrt(df))
    square, total = math.cos(angle) ** 2, 0.0
    if df % 2:
        term = math.cos(angle)
        for k in range(1, (df + 1) // 2):
            total, term = total + term, term * square * 2 * k / (2 * k + 1)
        return 0.5 - (angle + math.sin(angle) * total) / math.pi
    term = 1.0
    for k in range(1, df // 2 + 1):
        total, term = total + term, term * square * (2 * k - 1) / (2 * k)
    return 0.5 - math.sin(angle) * total / 2


def test_few_degrees(spark):
    pairs = [(t, df) for df in (*range(1, 13), 30, 99, 100, 999, 1000, 1001, 3000)
             for t in (0.0, 1e-9, 0.01, 0.4, 1.0, 1.7, 1.74, 2.5, 3.9, 4.1, 6.0, 9.0, 40.0, 1e4)]
    for (t, df), p in zip(pairs, _tails(spark, pairs), strict=True):
        assert p == pytest.approx(_exact(t, df), abs=1e-12), (t, df)


def _integrated_exactly(t, df):
    """Gauss-Legendre quadrature with the scale from its series in 1/df."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(300)
    u, z = (x + 1) / 2 * t, 4.0 * df
    scale = (1 - 1 / z + 1 / (2 * z * z) + 5 / (2 * z ** 3)) / math.sqrt(2 * math.pi)
    return 0.5 - scale * float((w * np.exp(-(df + 1) / 2 * np.log1p(u * u / df))).sum()) * t / 2


def test_many_degrees(spark):
    pairs = [(t, df) for df in (999, 1000, 1001, 20_000, 10**6, 10**7) for t in (0.5, 1.0, 1.73, 1.74, 1.96, 3.5, 3.99, 4.01, 6.0)]
    for (t, df), p in zip(pairs, _tails(spark, pairs), strict=True):
        assert p == pytest.approx(_integrated_exactly(t, df), abs=1e-12), (t, df)
        assert p == pytest.approx(_integrated(t, df), abs=2e-11) if df < 10**6 else True


def test_extreme_arguments(spark):
    inf, nan = math.inf, math.nan
    up, down, none = _tails(spark, [(inf, 3), (-inf, 3), (None, 3)])
    assert (up, down, none) == (0.0, 1.0, None)
    assert math.isnan(_tails(spark, [(nan, 3)])[0]) and _tails(spark, [(1e200, 1)])[0] < 1e-190


def _runs(spark, baseline, candidate):
    rows = [(1, BASELINE_MODEL, i, float(v)) for i, v in enumerate(baseline)]
    rows += [(1, CANDIDATE_MODEL, i, float(v)) for i, v in enumerate(candidate)]
    return spark.createDataFrame(rows, "config long, model string, run_no long, m double")


def _tested(spark, baseline, candidate):
    return paired_t_test(paired_differences(_runs(spark, baseline, candidate), ["config"], ["m"]), ["config"])


CASES = [
    ("shorter sample decides the pairs", [1, 2, 3, 4, 50], [2, 4, 3, 6], 4, None, "baseline better"),
    ("equal positive differences", [1, 2, 3], [2, 3, 4], 3, 0.0, "baseline better"),
    ("equal negative differences", [2, 3, 4], [1, 2, 3], 3, 1.0, "declarative better"),
    ("no difference", [1, 2], [1, 2], 2, None, "equal"),
    ("one pair", [1], [5], 1, 0.0, "insufficient"),
]


@pytest.mark.parametrize("baseline,candidate,n,p,verdict", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_paired_t_test(spark, baseline, candidate, n, p, verdict):
    tests = _tested(spark, baseline, candidate)
    row = tests.where("direction = 'candidate_greater'").first()
    assert row.n == n
    if p is not None:
        assert row.p == p
    if verdict != "baseline better" or p is not None:
        assert verdicts(tests, ["config"]).first().verdict == verdict


def test_t_statistic(spark):
    row = _tested(spark, [1, 2, 3, 4], [2, 4, 3, 6]).where("direction = 'candidate_greater'").first()
    assert row.mean_diff == pytest.approx(1.25)
    assert row.sd_diff == pytest.approx(0.9574271, abs=1e-6)
    assert row.t == pytest.approx(2.6111648, abs=1e-6)
    assert row.p == pytest.approx(0.0398, abs=1e-3)


def test_one_model_only_is_not_paired(spark):
    assert _tested(spark, [1, 2, 3], []).count() == 0
