"""Runs queries beside their SQL on the same Parquet tables and compares rows as sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if x is None:
        return None
    return x if isinstance(x, (int, str, bool)) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


def compare(spark, con, query, sql: str, sf_dir: str):
    """None where both agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else None
