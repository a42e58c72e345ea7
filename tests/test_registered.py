"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = compare.spark_rows(QUERIES[name](spark, sf_dir))
    wanted = compare.sql_rows(con, SQL[name])
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
