"""Every registered query at the smallest scale; those with SQL must give the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    rows, _, problem = compare(spark, tiny, name, QUERIES[name], ORACLES.get(name), con)
    spark.catalog.clearCache()
    assert problem is None
    assert rows > 0 or name in ("LK8_false_positives",)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"lang", "score", "n"}
