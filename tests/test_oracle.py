"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, name, QUERIES[name], SQL[name], SF_DIR, con)
    assert ok, note
    assert "TYPES" not in note, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, con, name):
    ok, note = compare(spark, name, QUERIES[name], None, SF_DIR, con)
    assert ok, note


def test_entry_is_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["grp", "period", "mean_distance", "std_distance", "sample_size", "rate"]
    assert df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
