"""Reading landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
