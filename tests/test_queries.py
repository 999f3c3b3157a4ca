"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as e

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = e.queries()[name](spark, sf_dir)
    truth = tables.execute(e.oracle_sql()[name])
    columns = [c[0] for c in truth.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, truth.fetchall())


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0
