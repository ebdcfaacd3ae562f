"""Runs a registered query and its oracle and compares rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


KINDS = {
    "tinyint": "i", "smallint": "i", "int": "i", "bigint": "i", "INTEGER": "i", "BIGINT": "i", "double": "f",
    "DOUBLE": "f", "float": "f", "FLOAT": "f", "string": "s", "VARCHAR": "s", "boolean": "b", "BOOLEAN": "b",
    "timestamp": "t", "timestamp_ntz": "t", "TIMESTAMP": "t", "TIMESTAMP WITH TIME ZONE": "t", "date": "d", "DATE": "d",
}


def compare(spark, query, sql: str, sf: str, connection) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf)
    spark_columns, spark_rows = normal(df.columns, df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    duck_columns, duck_rows = normal(names, result.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} against {duck_columns}"
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != KINDS.get(types[name], types[name]):
            return f"type of {name}: {kind} against {types[name]}"
    if len(spark_rows) != len(duck_rows):
        missing = [r for r in duck_rows if r not in set(spark_rows)][:2]
        extra = [r for r in spark_rows if r not in set(duck_rows)][:2]
        return f"{len(spark_rows)} rows against {len(duck_rows)}; missing {missing}; extra {extra}"
    for left, right in zip(spark_rows, duck_rows):
        if left != right:
            return f"row {str(left)[:600]} against {str(right)[:600]}"
    return None if spark_rows else "no rows on either side"
