"""Comparing a query with its DuckDB oracle."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names and values agree, else what differs."""
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    want = _rows(relation.columns, relation.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {sorted(df.columns)} got {got[:2]} want {want[:2]}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"{sorted(df.columns)} got {mine} want {theirs}"
    return None
