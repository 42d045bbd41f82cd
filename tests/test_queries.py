"""Every registered query runs; those with an SQL form give the same rows as DuckDB."""

import pytest
from conftest import SMALL
from oracle import compare

from minekit.plans import all_queries

QUERIES = all_queries()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_same_as_sql(spark, con, name):
    q = QUERIES[name]
    problem, _ = compare(q.run(spark, SMALL), con, q.sql)
    assert problem is None


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_runs(spark, name):
    df = QUERIES[name].run(spark, SMALL)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
