"""Runs a query and its oracle and compares names, row counts and values."""

from __future__ import annotations

import math

import duckdb

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}
TABLES = ["lineitem", "orders", "part", "supplier", "customer"]


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'"
        )
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return (type(value).__name__, str(value))


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(frame, connection, text: str) -> str | None:
    result = connection.sql(text)
    expected_columns = result.columns
    expected_types = dict(zip(expected_columns, map(str, result.types)))
    types = {name: TYPES.get(kind, kind) for name, kind in frame.dtypes}
    if types != expected_types:
        return f"columns {types} != {expected_types}"
    expected = result.fetchall()
    got = normalised(frame.columns, [tuple(row) for row in frame.collect()])
    wanted = normalised(expected_columns, expected)
    if got == wanted:
        return None
    only = [row for row in got if row not in wanted][:3]
    missing = [row for row in wanted if row not in got][:3]
    return f"{len(got)} rows, {len(wanted)} wanted; only here {only}; missing {missing}"
