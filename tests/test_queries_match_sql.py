"""Every query with SQL gives what DuckDB gives over the same tables; every query has a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(pdf):
    return sorted((tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    found, wanted = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["paired_bootstrap"])
def test_queries_without_sql(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["neg_id", "n_edges"]
