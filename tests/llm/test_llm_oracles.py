"""Corpus queries with SQL give the same rows in Spark and DuckDB."""

import pytest

import compare
from eligra.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare.difference(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name]) is None
