"""Spark results against DuckDB: same columns, same rows in any order."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x if isinstance(x, (int, bool)) or x is None else str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(frame, con, sql: str) -> str:
    """Empty if both give the same rows."""
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
