"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from meterlens.oracle import ORACLE
from meterlens.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 9)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    own = con.execute(ORACLE[name])
    columns = [c[0] for c in own.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, own.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
