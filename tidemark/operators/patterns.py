"""Design-pattern candidates from class names and method shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import large_join
from tidemark.operators.rules import finding_rows

# Names that point to a pattern, and bases that mean nothing.
INSTANCE_METHOD = r"(?i)^(get[_-]?instance|instance)$"
FACTORY_METHOD = r"(?i)^(create|make|build)[A-Z_]"
FACTORY_CLASS = r"(?i)factory$"
REPOSITORY_CLASS = r"(?i)(repository|repo)$"
CRUD_METHOD = r"(?i)^(find|get|create|update|delete|save|list)"
SUBSCRIBE_METHOD = r"(?i)^(subscribe|on|add[_-]?listener|add[_-]?event[_-]?listener)"
NOTIFY_METHOD = r"(?i)^(emit|notify|dispatch|publish)"
BUILDER_CLASS = r"(?i)builder$"
NAMED_ONLY = {"ADAPTER": r"(?i)adapter$", "DECORATOR": r"(?i)decorator$", "FACADE": r"(?i)facade$"}
GENERIC_BASES = ["object", "exception", "error", "component"]
STRUCTURAL, BY_NAME, FAMILY = 45, 30, 55
CRUD_METHODS = 2

CLASS = ["repository_id", "file_path", "id"]


def pattern_candidates(symbols: DataFrame) -> DataFrame:
    """All pattern candidates but STRATEGY: one aggregate per class, then one row per hit."""
    name = F.col("name")
    methods = symbols.filter("kind = 'METHOD'").groupBy("repository_id", "file_path", F.col("parent_id").alias("id")).agg(
        F.bool_or(name.rlike(INSTANCE_METHOD)).alias("instance"), F.bool_or(name.rlike(FACTORY_METHOD)).alias("factory"),
        F.count_if(name.rlike(CRUD_METHOD)).alias("crud"), F.bool_or(name.rlike(SUBSCRIBE_METHOD)).alias("subscribe"),
        F.bool_or(name.rlike(NOTIFY_METHOD)).alias("notify"), F.bool_or(F.lower(name) == "build").alias("builds"))
    classes = symbols.filter("kind = 'CLASS'").join(methods, CLASS, "left").fillna(
        False, ["instance", "factory", "subscribe", "notify", "builds"]).fillna(0, ["crud"])

    def hit(pattern: str, condition, confidence: int):
        return F.when(condition, F.struct(F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence")))

    hits = F.array_compact(F.array(
        hit("SINGLETON", F.col("instance"), STRUCTURAL),
        hit("FACTORY", name.rlike(FACTORY_CLASS) | F.col("factory"), STRUCTURAL),
        hit("REPOSITORY", name.rlike(REPOSITORY_CLASS) & (F.col("crud") >= CRUD_METHODS), STRUCTURAL),
        hit("OBSERVER", F.col("subscribe") & F.col("notify"), STRUCTURAL),
        hit("BUILDER", name.rlike(BUILDER_CLASS) & F.col("builds"), STRUCTURAL),
        *[hit(pattern, name.rlike(regex), BY_NAME) for pattern, regex in NAMED_ONLY.items()]))
    return _as_findings(classes.select(*classes.columns, F.inline(hits)))


def _as_findings(hits: DataFrame, metadata=None) -> DataFrame:
    label = F.initcap(F.replace("pattern", F.lit("_"), F.lit(" ")))
    return finding_rows(
        hits, type=F.col("pattern"), category="PATTERN", severity="INFO", confidence=F.col("confidence"),
        title=F.concat(F.lit("`"), "name", F.lit("` looks like a "), label, F.lit(" pattern")), symbol_name=F.col("name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"), metadata=metadata)


def strategy_families(symbols: DataFrame) -> DataFrame:
    """Per base: how many listings it has and the methods every listing class shares.

    Only counts are aggregated per base. A base with very many classes reduces
    map-side; its shared methods are at most those of one class.
    """
    memberships = _memberships(symbols)
    sizes = memberships.groupBy("repository_id", "base").agg(F.count("*").alias("siblings"))
    owners = memberships.select("repository_id", "base", "file_path", "id").distinct()
    members = owners.groupBy("repository_id", "base").agg(F.count("*").alias("classes"))
    methods = symbols.filter("kind = 'METHOD'").select(
        "repository_id", "file_path", F.col("parent_id").alias("id"), F.col("name").alias("method")).distinct()
    shared = (
        large_join(large_join(owners, methods, CLASS).groupBy("repository_id", "base", "method").agg(F.count("*").alias("n")),
                   members, ["repository_id", "base"]).filter("n = classes")
        .groupBy("repository_id", "base").agg(F.sort_array(F.collect_list("method")).alias("shared_methods")))
    return large_join(sizes.filter("siblings >= 2"), shared, ["repository_id", "base"])


def strategy_candidates(symbols: DataFrame) -> DataFrame:
    """One finding per class of each strategy family."""
    rows = _memberships(symbols)
    hits = large_join(rows, strategy_families(symbols), ["repository_id", "base"])
    hits = hits.withColumn("pattern", F.lit("STRATEGY")).withColumn("confidence", F.lit(FAMILY))
    return _as_findings(hits, F.to_json(F.struct(
        F.col("base").alias("shared_base"), F.col("siblings").alias("sibling_count"), "shared_methods")))


def _memberships(symbols: DataFrame) -> DataFrame:
    """(class, base) for every listed base, interfaces before superclasses."""
    listed = F.concat(F.split(F.coalesce("interfaces", F.lit("")), ","), F.split(F.coalesce("superclasses", F.lit("")), ","))
    classes = symbols.filter("kind = 'CLASS'")
    rows = classes.select(
        "repository_id", "file_path", "id", "name", "start_line", "end_line", F.explode(listed).alias("base"))
    return rows.withColumn("base", F.trim("base")).filter((F.col("base") != "") & ~F.lower("base").isin(GENERIC_BASES))
