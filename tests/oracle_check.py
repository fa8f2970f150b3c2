"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import pathlib

import duckdb


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    picked = [tuple(_plain(row[at]) for at in order) for row in rows]
    return sorted(picked, key=repr)


def spark_rows(df):
    return sorted(df.columns), _sorted_rows(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(folder, sql):
    connection = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    result = connection.execute(sql)
    columns = [entry[0] for entry in result.description]
    return sorted(columns), _sorted_rows(columns, result.fetchall())


def differences(df, folder, sql):
    """Empty when columns and rows agree, else a short description."""
    columns, rows = spark_rows(df)
    want_columns, want = duckdb_rows(folder, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if rows != want:
        first = next((pair for pair in zip(rows, want) if pair[0] != pair[1]), None)
        return f"{len(rows)} rows, wanted {len(want)}; first difference {str(first)[:1500]}"
    return ""
