"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if value.__class__.__name__ == "Decimal":
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cursor = con.execute(sql)
    want_columns, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = rows(spark_df.columns, spark_df.collect())
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(want) != len(got):
        return f"{len(got)} rows, expected {len(want)}; e.g. {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, e.g. got {bad[0][0]} expected {bad[0][1]}"
    if not want:
        return "no rows to compare"
    return None
