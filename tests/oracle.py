"""A query against its SQL, on the driver's tables."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differs(spark, query, sql, folder):
    """None if both give the same rows, else a few rows of each side."""
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = con.execute(sql)
    theirs_names = [d[0] for d in found.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
