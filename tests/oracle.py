"""Comparing a query with its DuckDB equivalent on one folder of tables."""

import glob
import os

import duckdb


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if v != v else repr(round(float(v), 5) + 0.0)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted("|".join(plain(row[i]) for i in order) for row in r.fetchall())
