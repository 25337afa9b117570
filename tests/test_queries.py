"""Every named query with SQL gives the same rows as that SQL."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck, as_set):
    df = entry.queries()[name](spark, sf_dir)
    found = as_set(df.columns, df.collect())
    wanted = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert found == as_set(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
