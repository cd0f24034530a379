"""Side-by-side check of a registered query and its oracle SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TESTDATA = Path("/root/testdata")

_KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted((TESTDATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v + 0.0 if isinstance(v, float) else v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when column names, types and rows (in any order) agree."""
    cur = con.execute(sql)
    theirs_types = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    names = sorted(df.columns)
    if names != sorted(theirs_types):
        return [f"columns {names} vs {sorted(theirs_types)}"]
    found = [
        f"type of {n}: {t} vs {theirs_types[n]}"
        for n, t in df.dtypes
        if _KINDS.get(t) != theirs_types[n]
    ]
    order = [list(theirs_types).index(n) for n in names]
    right = sorted((tuple(_value(r[i]) for i in order) for r in theirs), key=_key)
    left = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=_key)
    if len(left) != len(right):
        found.append(f"rows {len(left)} vs {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if wrong:
        cells = [(n, x, y) for n, x, y in zip(names, *wrong[0], strict=True) if x != y]
        found.append(f"{len(wrong)} rows differ, first: {str(cells)[:400]} in {str(wrong[0][0])[:120]}")
    return found
