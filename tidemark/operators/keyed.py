"""Building blocks keyed by a group that may be very large.

One repository, service or author can own a third of all rows. Each helper
here therefore reduces rows before the shuffle, or splits the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Order, k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows of each key.

    Filtering on row_number lets the optimizer keep `k` rows per key and map
    task ahead of the shuffle, so a hot key sends only k rows per task.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def salted_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "inner", salts: int = 16,
) -> DataFrame:
    """Equi-join where `small` is a small table and `large` may have very many rows per key.

    For lookups in dimension tables. Two large tables are joined plainly:
    repeating one per salt would cost more than the hot key, and adaptive
    execution splits the partition a hot key fills.

    `large` spreads each key over `salts` partitions by a hash of `spread_by`;
    `small` is repeated once per salt. The result is that of the plain join.
    `how` is inner, left, left_semi or left_anti.
    """
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def large_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the input.

    Neither side is broadcast: the planner's estimate does not count the rows
    that `explode` makes, and a side that it takes for small would go through
    the driver. A hot key of `left` is split by adaptive execution.
    """
    return left.join(right.hint("merge"), list(keys), how)


def asof_last(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    right_order: Sequence[str], payload: Sequence[str], result: str, bucket_seconds: int = 6 * 3600,
) -> DataFrame:
    """For each left row the latest right row at or before it, as struct `result`.

    Rows are split by (key, time bucket), so that a hot key spreads over its
    buckets. A left row whose bucket holds no earlier right row takes the last
    right row of an earlier bucket: that carry is one row per non-empty bucket,
    found by an aggregate that combines map-side. Cost is one sort; no pair of
    rows is ever built. `right_order` breaks ties at equal times (last wins).
    """
    keys = list(keys)

    def bucket(time: str) -> Column:
        return F.floor(F.unix_micros(F.col(time)) / F.lit(bucket_seconds * 1_000_000)).cast("long")

    hit = F.struct(
        F.col(right_time).alias("_at"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)],
        *[F.col(c).alias(c) for c in payload],
    )
    rights = right.filter(F.col(right_time).isNotNull()).select(
        *keys, bucket(right_time).alias("_bucket"), F.col(right_time).alias("_time"), hit.alias("_hit")
    )
    lefts = left.withColumn("_bucket", bucket(left_time)).withColumn("_time", F.col(left_time))
    lefts = lefts.withColumn("_left", F.struct(*[F.col(c) for c in left.columns]))

    # Carry-in: the last hit of each bucket, then the running last over buckets.
    # Rows here number buckets, not events.
    tails = rights.groupBy(*keys, "_bucket").agg(F.max("_hit").alias("_tail"))
    wanted = lefts.select(*keys, "_bucket").distinct()
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        wanted.join(tails, [*keys, "_bucket"], "full_outer")
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_bucket", "_carry")
    )

    no_hit = F.lit(None).cast(rights.schema["_hit"].dataType)
    no_left = F.lit(None).cast(lefts.schema["_left"].dataType)
    both = (
        rights.select(*keys, "_bucket", "_time", F.lit(0).alias("_side"), "_hit", no_left.alias("_left"))
        .unionByName(lefts.select(*keys, "_bucket", "_time", F.lit(1).alias("_side"), no_hit.alias("_hit"), "_left"))
    )
    ties = [F.col(f"_hit._o{i}").asc_nulls_first() for i in range(len(right_order))]
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy("_time", "_side", *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = both.withColumn("_seen", F.last("_hit", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    joined = seen.join(carries, [*keys, "_bucket"], "left")
    found = F.coalesce("_seen", "_carry")
    picked = F.when(
        found.isNotNull(), F.struct(found["_at"].alias(right_time), *[found[c].alias(c) for c in payload])
    )
    return joined.select(F.col("_left.*"), picked.alias(result))
