"""The registered queries opN_ of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    clusters,
    digests,
    extraction,
    jaccard,
    language,
    lexical,
    mixing,
    neardups,
    neighbours,
    oracles,
    packing,
    repeats,
    scoring,
    sharding,
)
from tidemark.llm.common import crc_of_id, table, text_key
from tidemark.session import ensure


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).drop("slots")


def op2_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_water_fill_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, F.col("words"), [F.col("doc_id"), F.col("source"), F.col("words")])
    taken = F.col("mix.copies") * F.col("mix.size") + F.col("mix.extra")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


def op5_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("key")


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_min_cost_flow_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(spark, docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"))


def op8_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure(spark, by_bytes=True)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text_key(F.col("text")).alias("key"))
    left = repeats.remove_repeats(docs, repeats.repeats(docs, joined=True), carry=["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests.compare_with_next(docs, digests.rarity(docs))


def op10_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id("doc_id") % 3 == 1
    dictionaries = language.learn(docs, ~held_out)
    told = language.identify(docs.select("doc_id", "text"), dictionaries)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_sparse_product_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and numbers of links at 90% of common 3-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_subvector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every usable vector after five rounds of 40 centroids."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[query.__name__] = lambda spark, sf_dir: query(ensure(spark), sf_dir)
    if oracle is not None:
        ORACLES[query.__name__] = oracle


for _query in (
    op1_template_extraction, op2_elias_fano_scores, op3_multiprobe_neighbours, op4_water_fill_mix, op5_hamming_near_duplicates,
    op6_cost_balanced_packing, op7_min_cost_flow_shards, op8_interval_tree_repeats, op9_improbable_features, op10_zstd_language,
):
    _add(_query)
_add(op11_sparse_product_join, oracles.ngram_links())
_add(op12_presence_mask_search, oracles.ranked_search())
_add(op13_subvector_centroids, oracles.centroids())
