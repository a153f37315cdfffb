"""Compare a query with its SQL over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def same(spark, query, sql, sf):
    got = query(spark, sf)
    want = connect(sf).sql(sql)
    names = sorted(want.columns)
    assert set(names) <= set(got.columns)
    key = lambda rows: sorted(repr(tuple(plain(v) for v in r)) for r in rows)
    a = key(tuple(r) for r in got.select(*names).collect())
    b = key(want.select(*map(lambda n: '"' + n + '"', names)).fetchall())
    assert a == b
