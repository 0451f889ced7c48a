"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_sql_has_a_query_each():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
