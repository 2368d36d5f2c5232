"""Compare a registered query with its SQL in DuckDB, the way the driver does."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = [p.stem for p in (DATA / "sf0.001").glob("*.parquet")]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def compare(spark_df, con, statement: str) -> str | None:
    """None when equal, else a description of the first difference."""
    names, got = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(statement)
    want_names, want = _table([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a}\n   sql   {b}"
    types = lambda rows: [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(len(names))]
    if types(got) != types(want):
        return f"types {types(got)} != {types(want)}"
    return None
