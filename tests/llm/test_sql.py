"""The SQL of the training-data operators on the same tables in DuckDB."""

import duckdb
import pytest

from meterlens.llm.queries import ORACLE, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in (r[i] for i in order)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    own = con.execute(ORACLE[name])
    columns = [c[0] for c in own.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, own.fetchall())
