"""Containment of syntax-tree nodes without a range join.

Nodes carry nested-set numbers: `pre` where a node opens, `post` where it
closes, both from one counter per file. Everything is partitioned by file,
which the scan limit keeps under a million bytes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["repository_id", "file_path"]


def levels(ast: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Per node and flag, how many flagged nodes are open there, itself included."""
    flagged = ast
    for name, flag in flags.items():
        flagged = flagged.withColumn(f"_is_{name}", F.coalesce(flag, F.lit(False)))
    any_flag = F.lit(False)
    for name in flags:
        any_flag = any_flag | F.col(f"_is_{name}")

    def event(at: str, step: int) -> Column:
        return F.struct(F.col(at).alias("_pos"), F.lit(step).alias("_step"))

    # All that a node does comes from one reading of it. A flagged leaf opens and closes on the spot: later nodes must not see it.
    events = flagged.select("*", F.inline(F.array_compact(F.array(
        event("pre", 1), F.when(any_flag & (F.col("post") > F.col("pre")), event("post", -1)),
        F.when(any_flag & (F.col("post") <= F.col("pre")), event("pre", -2))))))
    running = Window.partitionBy(*FILE).orderBy("_pos", F.desc("_step")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for name in flags:
        step = F.when(F.col(f"_is_{name}"), F.signum(F.col("_step")).cast("int")).otherwise(F.lit(0))
        events = events.withColumn(f"{name}_level", F.sum(step).over(running).cast("int"))
    return events.filter(F.col("_step") == 1).drop("_pos", "_step", *[f"_is_{n}" for n in flags])


def contained(ast: DataFrame, outer: Column, inner: Column, outer_columns: Mapping[str, Column],
              inner_columns: Mapping[str, Column]) -> DataFrame:
    """One row per (outer, inner) pair where inner lies in outer or is outer.

    A node at container level d lies in exactly one open container per level
    1..d, namely the last one opened at that level. So each inner row is
    repeated d times and picks its containers by a window: the work is the
    size of the result, whatever the number of containers in the file.
    """
    base = ast.withColumn("_outer", F.coalesce(outer, F.lit(False))).withColumn(
        "_inner", F.coalesce(inner, F.lit(False))
    )
    # Nodes that are neither count for nothing in the levels: they go before the sort.
    ranked = levels(base.filter(F.col("_outer") | F.col("_inner")), {"outer": F.col("_outer")})
    outer_value = F.struct(*[c.alias(n) for n, c in outer_columns.items()])
    inner_value = F.struct(*[c.alias(n) for n, c in inner_columns.items()])
    nowhere = F.array().cast("array<struct<_level:int,_side:int>>")
    opened = F.when(F.col("_outer"), F.array(F.struct(F.col("outer_level").alias("_level"), F.lit(0).alias("_side")))).otherwise(nowhere)
    inside = F.when(F.col("_inner") & (F.col("outer_level") > 0), F.transform(
        F.sequence(F.lit(1), F.col("outer_level")), lambda level: F.struct(level.alias("_level"), F.lit(1).alias("_side")))).otherwise(nowhere)
    placed = ranked.select("*", F.inline(F.concat(opened, inside))).select(
        *FILE, "_level", F.col("pre").alias("_pos"), "_side",
        F.when(F.col("_side") == 0, outer_value).alias("_out"), F.when(F.col("_side") == 1, inner_value).alias("_in"))
    last_opened = Window.partitionBy(*FILE, "_level").orderBy("_pos", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    pairs = placed.withColumn("_out", F.last("_out", ignorenulls=True).over(last_opened))
    return pairs.filter(F.col("_side") == 1).select(*FILE, "_out.*", "_in.*")


def children(ast: DataFrame, parents: DataFrame, prefix: str = "child_") -> DataFrame:
    """Each parent row joined to its direct child nodes, on (file, node id)."""
    kids = ast.select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("node_id").alias(f"{prefix}id"),
        F.col("pre").alias(f"{prefix}pre"), F.col("type").alias(f"{prefix}type"),
        F.col("is_named").alias(f"{prefix}is_named"), F.col("field").alias(f"{prefix}field"),
        F.col("text").alias(f"{prefix}text"),
    ).filter(F.col("node_id").isNotNull())
    return parents.join(kids, [*FILE, "node_id"], "inner")


def field_text(ast: DataFrame, field: str, name: str) -> DataFrame:
    """(file, node id, text and type of the child in `field`)."""
    return ast.filter((F.col("field") == field) & F.col("parent_id").isNotNull()).select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("node_id").alias(f"{name}_id"),
        F.col("type").alias(f"{name}_type"), F.col("text").alias(name),
    )
