"""Keyed Parquet tables that take upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.delivery import upsert
from tidemark.session import cut_lineage

BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows by hash of the whole key, so that no owner of many rows fills a bucket alone."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count the table was made with; None where there is no table."""
    try:
        return spark.read.schema("buckets int").json(_beside(path)).first()["buckets"]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}-buckets"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def write_upsert(
    updates: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str] | None = None,
    keep_null: Sequence[str] = (), newest_first: Sequence[Column] | None = None, buckets: int = 64,
) -> None:
    """Upserts `updates` into the table at `path`, creating it when absent.

    The table is partitioned by a hash bucket of the key. Only buckets that
    receive an update are read, merged and overwritten; the list of those is at
    most `buckets` integers. At scale choose buckets so that one is about a
    gigabyte. Applying the same updates twice changes nothing.

    The updates are landed once, so the buckets listed are the buckets written
    even if their source gives other rows when read again. The bucket count
    stands beside the table; another count is refused, as it would part keys.
    Buckets are overwritten in place: one writer at a time.
    """
    spark = updates.sparkSession
    keys = list(keys)
    stored_count = _stored_buckets(spark, path)
    if stored_count not in (None, buckets):
        raise ValueError(f"the table at {path} has {stored_count} buckets, not {buckets}")
    updates = cut_lineage(updates)
    incoming = _bucketed(updates, keys, buckets)
    if stored_count is not None:
        touched = [row[0] for row in incoming.select(BUCKET).distinct().collect()]
        if not touched:
            return
        stored = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    else:
        stored = updates.limit(0).select(*[c for c in updates.columns if not c.startswith("_")])
    merged = upsert(stored, updates, keys, columns, keep_null, newest_first)
    writer = _bucketed(merged, keys, buckets).repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    if stored_count is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(_beside(path))
