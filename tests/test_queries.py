"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # for queries that find nothing in the smallest tables
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    problem = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    if problem == "no rows to compare":
        problem = compare(spark, connect(LARGER), name, QUERIES[name], ORACLES[name], LARGER)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
