"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, list):
        return tuple(cell(v) for v in value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v).__name__ in ("int", "float")), str(v)) for v in r))


def compare(spark, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    df = run(spark, sf_dir)
    got_columns = df.columns
    got = rows(got_columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    try:
        result = con.execute(sql)
        want_columns = [d[0] for d in result.description]
        want = rows(want_columns, result.fetchall())
    finally:
        con.close()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}; e.g. {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"
    return None
