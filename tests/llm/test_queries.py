"""Queries with a SQL twin give the same rows on the small tables."""

import os

import pytest

from engram.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = os.environ.get("ENGRAM_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    err, rows = compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name])
    assert err is None, err
    assert rows > 0
