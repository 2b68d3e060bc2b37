"""Runs a query and its SQL counterpart and compares the rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if hasattr(x, "as_py"):
        x = x.as_py()
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return str(x)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())


def duck_rows(directory: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def differences(df, directory: str, sql: str) -> list[str]:
    (a, x), (b, y) = spark_rows(df), duck_rows(directory, sql)
    if a != b:
        return [f"columns {a} and {b}"]
    if x == y:
        return []
    return [f"{sum(x.values())} rows and {sum(y.values())}", f"only Spark: {list((x - y).items())[:3]}", f"only SQL: {list((y - x).items())[:3]}"]
