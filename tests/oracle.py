"""Compares a query's rows with DuckDB's, whatever their order."""

import glob
import math
import os
from datetime import date, datetime
from decimal import Decimal


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return names, res.fetchall()


def same(df, sql, sf_dir):
    names, want = duck(sql, sf_dir)
    got = df.collect()
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    a, b = rows_of(df.columns, got), rows_of(names, want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
