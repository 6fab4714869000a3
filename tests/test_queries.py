"""Every registered query against its SQL."""

import pytest

import __spark_entry__
from registry.compare import difference, duckdb_tables
from registry.oracles import oracle_sql
from registry.queries import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duckdb_tables(SMALL)


def test_every_query_has_its_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, tables, name):
    assert difference(spark, SMALL, tables, name) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
