"""Mixing sources to target weights by capped water-filling.

Every source has a weight; together the sources share a number of words. A
source may be repeated `max_epochs` times at most: targets above that are
clamped and the excess goes to the others by weight until none is above. The
targets are then met by whole repetitions of every document and one seeded
fractional repetition.

Nulls, empty texts and edge cases: a null text has size 0; the null source is
a source of its own, last in order; a source without words has target 0; an
empty table gives an empty result; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, near
from tidemark.session import cut_lineage

BUCKETS = 4096  # slices of a source's seeded order; each is summed on its own


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Targets for `sources` (source, source_size): adds weight and target.

    Weights go round over the sources by code point, null last. A source is
    clamped when its cap per weight lies under the common level; with sources
    sorted by cap per weight the clamped ones are a prefix, so the level after
    all rounds of clamping comes from running sums. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sources.withColumn("_n", F.row_number().over(by_name) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(listed, (F.col("_n") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * max_epochs)
    rising = Window.orderBy(F.col("_cap") / F.col("weight"), "_n")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    run = (weighed
           .withColumn("_total", F.sum("source_size").over(everything) * share)
           .withColumn("_clamped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
           .withColumn("_open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("_level", F.greatest(F.col("_total") - F.col("_clamped"), F.lit(0.0)) / F.col("_open"))
           .withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("_cap")))
    # the level of the first source that is not clamped holds for all of them
    first = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("weight"), F.col("_n"), F.col("_level")))).over(everything)
    final = run.withColumn("_final", first["_level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_final") * F.col("weight")))
    return final.select("source", "source_size", "weight", target.cast("double").alias("target"))


def cuts(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
         max_epochs: float = 2.0) -> DataFrame:
    """Per source: target, whole copies, and where its fractional repetition ends.

    `docs` has source, _size and _place. A source takes its documents in the
    order of (slice, place) until its words are used up. Slices are summed
    first; only documents of the slice in which the target falls are ordered,
    so no task sees a whole source.
    """
    rows = docs.select("source", "_size", "_place", _slice("_place").alias("_slice"))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sliced = rows.groupBy("source", "_slice").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy(named).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = sliced.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    targets = water_fill(sliced.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("copies", F.least(whole, F.lit(int(max_epochs))).cast("long"))
    rest = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    targets = targets.withColumn("_rest", rest)
    renamed = targets.select(F.col("source").alias("_of"), "_rest")
    edge = (sliced.join(renamed, F.col("source").eqNullSafe(F.col("_of")))
            .where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_words")))
            .select("_of", F.col("_slice").alias("_cut_slice"), "_before", "_rest"))
    inside = (rows.join(edge, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_cut_slice")))
              .groupBy("_of", "_cut_slice", "_before", "_rest", "_place").agg(F.sum("_size").alias("_tied")))
    order = Window.partitionBy("_of").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_tied").over(order), F.lit(0)))
    last = inside.where((F.col("_start") < F.col("_rest")) & (F.col("_rest") <= F.col("_start") + F.col("_tied"))).select(
        F.col("_of").alias("_cut_of"), "_cut_slice", F.col("_place").alias("_cut_place"),
        (F.col("_rest") - F.col("_start")).alias("_cut_words"), "_tied")
    return targets.join(last, F.col("source").eqNullSafe(F.col("_cut_of")), "left").select(
        F.struct(F.col("source").alias("name"), "source_size", "target", "copies", "_cut_slice", "_cut_place",
                 "_cut_words", "_tied").alias("_cut"))


def _slice(place: str) -> Column:
    return F.pmod(F.col(place), F.lit(BUCKETS)).cast("int")


def mix(docs: DataFrame, size: Column, key: list[Column], *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Adds one column `mix` to `docs`: size, source_size, target, copies, extra.

    `key` names what seeds a row's place. `copies` is how often the whole
    document is taken, `extra` how many further words of it: a source takes
    its documents in seeded order until its target is met, so only the
    documents at one place per source are taken in part (rows alike in the
    whole key share what is left evenly). The documents themselves are joined
    with one row per source and move only if the sources are too many to
    broadcast.
    """
    rows = docs.withColumns({"_size": size, "_place": F.xxhash64(F.lit(seed), *key)})
    found = cut_lineage(cuts(rows, weights=weights, share=share, max_epochs=max_epochs))
    joined = rows.join(near(found, F.coalesce(F.octet_length("_cut.name"), F.lit(0)) + 64), F.col("source").eqNullSafe(F.col("_cut.name")))
    here, cut = F.struct(_slice("_place"), F.col("_place")), F.struct(F.col("_cut._cut_slice"), F.col("_cut._cut_place"))
    partly = F.floor(F.col("_cut._cut_words") * F.col("_size") / F.col("_cut._tied")).cast("long")
    extra = F.when(F.col("_cut._cut_place").isNull(), F.lit(0)).when(here < cut, F.col("_size")).when(
        here == cut, F.least(partly, F.col("_size"))).otherwise(F.lit(0)).cast("long")
    told = F.struct(F.col("_size").alias("size"), "_cut.source_size", "_cut.target", "_cut.copies", extra.alias("extra"))
    return joined.withColumn("mix", told).drop("_size", "_place", "_cut")


def repeat(mixed: DataFrame, columns: list[Column]) -> DataFrame:
    """The documents of a mix, each as often as it is taken.

    Documents stay whole: one that is taken in part counts as taken when at
    least half of it is.
    """
    times = F.col("mix.copies") + F.when((F.col("mix.extra") > 0) & (F.col("mix.extra") * 2 >= F.col("mix.size")), 1).otherwise(0)
    return mixed.select(*columns, F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_time")).drop("_time")
