"""Runs a query and its SQL twin on the same tables and says how the results differ."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    return v


def kind(rows, i):
    return {type(r[i]).__name__ for r in rows if r[i] is not None}


def difference(spark, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names, theirs = sorted(df.columns), sorted(rel.columns)
    if names != theirs:
        return f"columns {names} / {theirs}"
    got = [tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    at = [rel.columns.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    if not got:
        return "no rows"
    kinds = [(n, kind(got, i), kind(want, i)) for i, n in enumerate(names) if kind(got, i) != kind(want, i)]
    if kinds:
        return f"types {kinds}"
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"values {a} / {b}"
    return None
