"""Rows of a query and of its SQL in comparable form."""

import datetime
import math
import os

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (datetime.datetime, bytes)):
        return str(v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def both(spark, query, sql):
    import duckdb

    df = query(spark, DATA)
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    rel = c.sql(sql)
    return rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
