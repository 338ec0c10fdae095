"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference, rows_of_spark, rows_of_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows_of_spark(QUERIES[name](spark, FOLDER))
    if name in SQL:
        assert difference(got, rows_of_sql(con, SQL[name])) is None
    else:
        assert got[1]


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["retrieved_hits", "plan_verdicts", "folded_memory"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of_spark(QUERIES[name](spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
