"""Every registered query with SQL against DuckDB; the others run and return rows."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf, name):
    ok, info = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert ok, info


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).take(1)


def test_entry(spark):
    assert entry.entry(spark).take(1)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
