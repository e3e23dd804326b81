"""Runs a query in Spark and its SQL in DuckDB and compares the two results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def kind(x) -> str:
    return type(x).__name__


def compare(df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            if all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)):
                continue
            return f"{names}: {str(a)[:600]} and {str(b)[:600]}"
    types = dict(df.dtypes)
    duck = dict(zip(rel.columns, map(str, rel.types), strict=True))
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for n in names:
        if types[n] in same and duck[n] != same[types[n]]:
            return f"types of {n}: {types[n]} and {duck[n]}"
    return ""
