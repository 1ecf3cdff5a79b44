"""Runs a query and its oracle on the same parquet files and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from contrapunto.plans.analogs import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(con, name, df, sql):
    """None when equal, else a short text that shows the first difference."""
    cur = con.execute(sql)
    d_names, d_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if d_names != s_names:
        return f"{name}: columns {s_names} vs {d_names}"
    if len(d_rows) != len(s_rows):
        extra = set(map(repr, s_rows)) ^ set(map(repr, d_rows))
        return f"{name}: {len(s_rows)} vs {len(d_rows)} rows; e.g. {sorted(extra)[:2]}"
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return f"{name}: {s_names}\n   spark {a}\n   duck  {b}"
    return None
