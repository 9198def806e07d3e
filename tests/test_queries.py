"""Every query runs over the small tables; those with SQL must agree with it."""

from __future__ import annotations

import pytest

from catalog import ORACLES, QUERIES
from catalog.compare import difference, open_duckdb, oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = spark_rows(QUERIES[name](spark, FOLDER))
    assert found[0]
    if name in ORACLES:
        assert difference(found, oracle_rows(con, ORACLES[name])) is None


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
