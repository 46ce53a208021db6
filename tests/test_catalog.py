"""Every registered query with comparison SQL, against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from flowsieve.catalog import load
from tools.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_comparison_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_query_of_the_catalog_has_a_comparison():
    queries, sql = load()
    assert set(queries) == set(sql)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches(spark, con, name):
    note, _, ok = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert ok, note


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 1000 and df.where("score_fx < 0 OR score_fx > 1000000000").count() == 0
