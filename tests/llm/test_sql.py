"""The queries that SQL can express, side by side with DuckDB."""

import pytest
from oracle import compare, connect

from spectraloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, message = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok, message
