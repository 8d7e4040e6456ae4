"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    n, problem = compare(spark, FOLDER, QUERIES[name], SQL.get(name))
    assert not problem, problem
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
