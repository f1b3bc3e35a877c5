"""Every registered query equals its SQL twin on whole tables."""

from __future__ import annotations

import pytest
from compare import difference

import __spark_entry__ as entry_point
from driftwatch.plans import oracles, queries

QUERIES, ORACLES = queries.QUERIES, oracles.ORACLES


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) is None


def test_entry(spark):
    alerts = entry_point.entry(spark)
    assert alerts.columns == ["motor_id", "window_start", "time", "failure"]
    assert alerts.count() == 7
