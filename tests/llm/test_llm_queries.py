"""The operators' queries over the small tables, against their SQL."""

from __future__ import annotations

import pytest

from catalog.compare import difference, open_duckdb, oracle_rows, spark_rows
from gleaner.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    found = spark_rows(QUERIES[name](spark, FOLDER))
    assert difference(found, oracle_rows(con, ORACLES[name])) is None
