"""Comparing queries with their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

FOLDER = "/root/testdata/sf0.001"


def connection():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(data, columns, order):
    at = [columns.index(c) for c in order]
    return Counter(tuple(plain(r[i]) for i in at) for r in data)


def assert_same(spark, con, query, text):
    got = query(spark, FOLDER)
    want = con.sql(text)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.collect(), got.columns, names) == rows(want.fetchall(), want.columns, names)
