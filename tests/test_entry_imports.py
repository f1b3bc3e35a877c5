"""The core queries stay when the training-data subpackage cannot be imported."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry_point
from driftwatch.plans.queries import QUERIES


@pytest.mark.parametrize("missing", ["driftwatch.llm.queries", "driftwatch.llm.oracles"])
def test_missing_subpackage(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(entry_point.queries()) == set(QUERIES)


def test_missing_library(monkeypatch):
    """Without an optional library the modules that need it cannot be imported."""
    for name in [n for n in sys.modules if n.startswith("driftwatch.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = set(entry_point.queries())
    assert names >= set(QUERIES) and (names == set(QUERIES) or any(n.startswith("op") for n in names))


def test_missing_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry_point.queries()
