"""Registered queries of the subpackage that SQL can express equal their twins on whole tables."""

from __future__ import annotations

import pytest
from compare import difference

from driftwatch.llm.oracles import LLM_ORACLES
from driftwatch.llm.queries import LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_twin(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(LLM_QUERIES[name](spark, sf_dir), LLM_ORACLES[name], sf_dir) is None
