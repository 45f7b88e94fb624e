"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    told = duck.execute(ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, told.fetchall())



def test_edges_are_drawn_from_directories_not_files(spark):
    """All expressions over edges meet a row a directory: nothing of the view reads the orders any more."""
    from tidemark.plans.views import view

    assert not [f for f in view(spark, DATA, "dir_edges").inputFiles() if f.endswith("orders.parquet")]
