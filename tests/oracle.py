"""Compares registered queries with their DuckDB SQL, as multisets of rows with columns in order of name."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return v


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def differences(df, con, sql: str) -> str:
    """Empty where both agree."""
    (ca, a), (cb, b) = spark_rows(df), sql_rows(con, sql)
    if ca != cb:
        return f"columns {ca} and {cb}"
    if a != b:
        return f"rows {a.total()} and {b.total()}; only Spark {list((a - b).items())[:2]}; only SQL {list((b - a).items())[:2]}"
    return ""
