"""Shared pieces of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII white-space bytes. On UTF-8
# bytes this is exactly bytes.split(), and bytes.lower() is exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_of_id(column: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_key(text: Column) -> Column:
    """64-bit identity of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pieces(total: int | None, each: int) -> int:
    """How many parts of about `each` hold `total`; 1 at least."""
    return max(1, math.ceil((total or 0) / each))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of each slice hold about `limit` bytes.

    A single longer text makes a slice of its own. No row is left out.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size, start = 0, 0
        lengths = pc.binary_length(column).to_pylist()
        for row, length in enumerate(lengths):
            if size + (length or 0) > limit and row > start:
                yield batch.slice(start, row - start)
                size, start = 0, row
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


BROADCAST_BYTES = 64 << 20


def near(df: DataFrame, size: Column) -> DataFrame:
    """Marks `df` for broadcast if its measured size is small; else a join moves both sides."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total < BROADCAST_BYTES else df
