"""Run a registered query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def _key(row: tuple) -> tuple:
    return tuple((value is not None, "" if value is None else value) for value in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None if equal, else a short account of the first difference."""
    names, expected = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    picks = [names.index(name) for name in order]
    expected = sorted((tuple(row[i] for i in picks) for row in expected), key=_key)
    actual = sorted((tuple(row) for row in df.select(*order).collect()), key=_key)
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    for got, want in zip(actual, expected):
        if any(type(g) is not type(w) or not _same(g, w) for g, w in zip(got, want)):
            return f"{dict(zip(order, got))} != {dict(zip(order, want))}"
    return None
