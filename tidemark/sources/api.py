"""Raw API pages that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_api_json(df: DataFrame, ddl: str, column: str = "body") -> DataFrame:
    """`column` parsed by a fixed schema; unreadable text lands in `_corrupt`."""
    kept = [c for c in df.columns if c != column]
    parsed = df.withColumn("_p", F.from_json(
        column, f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select(*kept, "_p.*")
