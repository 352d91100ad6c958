"""Compare a Spark result with a DuckDB statement on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = 0.0 if value == 0 else value
        return f"{value:.9g}"
    if hasattr(value, "as_tuple"):
        return f"{float(value):.9g}"
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def normal(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(frame, con, statement: str) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(statement)
    right = normal([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ: {left[0]}\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return None
