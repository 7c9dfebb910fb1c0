"""Runs a registered query next to its SQL and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, Decimal):
        return repr(round(float(value), 9))
    if isinstance(value, (pd.Timestamp,)) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, int):
        return str(value)
    return str(value)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((c is None, c or "") for c in r))


def spark_rows(df):
    return sorted(df.columns), normal_rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), normal_rows(names, cur.fetchall())


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        only = list(set(left) - set(right))[:2], list(set(right) - set(left))[:2]
        return f"rows {len(left)} != {len(right)}; only spark/sql {only}"
    for a, b in zip(left, right):
        if a != b:
            return f"{left_names}: {a} != {b}"
    return None
