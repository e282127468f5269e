"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from brook.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(df):
    columns = sorted(df.columns)
    return columns, sorted(str(r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, tables, name):
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(tables.execute(ORACLES[name]).df())


def test_plans(spark):
    plan = lambda name: QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("topk_filtered") and "Exchange" not in plan("topk_filtered")
    assert "PushedFilters: [" in plan("eq_long") and "EqualTo(user_id,7)" in plan("eq_long")
    assert "Exchange" not in plan("grid_range")


def test_entry_without_the_text_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
