"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _rows(rows, names, order):
    place = [names.index(n) for n in order]
    return sorted((tuple(r[i] for i in place) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert _rows(df.collect(), df.columns, order) == _rows(found.fetchall(), names, order)


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 17
