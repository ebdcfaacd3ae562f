"""Health scores: penalties per category and type, and their combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as sc

# Which finding category or types feed each penalty score.
CATEGORY_SCORES = {"architecture": "DEPENDENCY", "security": "SECURITY", "performance": "PERFORMANCE"}
TYPE_SCORES = {
    "scalability": ["BLOCKING_OPERATION", "N_PLUS_ONE_QUERY", "HEAVY_DATABASE_CALL", "MISSING_CACHING"],
    "layering": ["LAYER_VIOLATION"],
}

# The scores that make up the overall score.
OVERALL_PARTS = [
    "architecture", "security", "performance", "maintainability", "documentation", "complexity", "technical_debt",
]


def _less_penalties(condition: Column) -> Column:
    points = F.coalesce(F.sum(F.when(condition, sc.severity_penalty(F.col("severity")))), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - points).cast("int")


def category_scores(findings: DataFrame, keys: Sequence[str] = ("repository_id",)) -> DataFrame:
    """100 less 12/6/3/1/0 per finding of the category, not below 0."""
    return findings.groupBy(*keys).agg(*[
        _less_penalties(F.col("category") == category).alias(f"{name}_score")
        for name, category in CATEGORY_SCORES.items()
    ])


def type_scores(findings: DataFrame, keys: Sequence[str] = ("repository_id",)) -> DataFrame:
    """The same over sets of finding types."""
    return findings.groupBy(*keys).agg(*[
        _less_penalties(F.col("type").isin(types)).alias(f"{name}_score") for name, types in TYPE_SCORES.items()
    ])


def penalty_scores(findings: DataFrame, keys: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Category scores, type scores and the penalty total in one aggregate."""
    columns = [
        _less_penalties(F.col("category") == category).alias(f"{name}_score")
        for name, category in CATEGORY_SCORES.items()
    ] + [_less_penalties(F.col("type").isin(types)).alias(f"{name}_score") for name, types in TYPE_SCORES.items()]
    total = F.sum(sc.severity_penalty(F.col("severity"))).alias("penalty")
    return findings.groupBy(*keys).agg(*columns, total)


def debt(findings: DataFrame, files: DataFrame) -> DataFrame:
    """100 less ten times the penalty per file; repositories come from `files`."""
    penalties = findings.groupBy("repository_id").agg(F.sum(sc.severity_penalty(F.col("severity"))).alias("penalty"))
    counts = files.groupBy("repository_id").agg(F.count("*").alias("files"))
    joined = counts.join(penalties, "repository_id", "left")
    return joined.select("repository_id", debt_score(F.col("penalty"), F.col("files")).alias("technical_debt_score"))


def debt_score(penalty: Column, files: Column) -> Column:
    density = F.coalesce(penalty, F.lit(0)) / F.greatest(F.coalesce(files, F.lit(0)), F.lit(1))
    return sc.clamp(sc.round_half_even(F.lit(100) - density * 10), 0, 100)


def documentation(symbols: DataFrame) -> DataFrame:
    """Share of classes, functions, methods and interfaces with a doc comment."""
    documented = F.coalesce(F.col("doc_comment"), F.lit("")) != ""
    counted = F.col("kind").isin("CLASS", "FUNCTION", "METHOD", "INTERFACE")
    grouped = symbols.groupBy("repository_id").agg(
        F.count_if(counted).alias("total"), F.count_if(counted & documented).alias("documented"))
    share = F.when(F.col("total") == 0, F.lit(100)).otherwise(
        sc.round_half_even(F.try_divide(F.col("documented"), F.col("total")) * 100))
    return grouped.select("repository_id", share.cast("int").alias("documentation_score"))


def complexity_score(complexity: DataFrame) -> DataFrame:
    """100 less five times the mean complexity of all functions."""
    mean = F.avg("complexity")
    score = sc.clamp(sc.round_half_even(F.lit(100) - mean * 5), 0, 100)
    return complexity.groupBy("repository_id").agg(score.alias("complexity_score"))


def file_maintainability(halstead: DataFrame, complexity: DataFrame, files: DataFrame) -> DataFrame:
    """Maintainability index per file from token volume, mean complexity and lines."""
    mean = complexity.groupBy("repository_id", "file_path").agg(F.avg("complexity").alias("mean_complexity"))
    lines = files.select("repository_id", F.col("path").alias("file_path"), "lines_of_code")
    joined = halstead.join(lines, ["repository_id", "file_path"]).join(mean, ["repository_id", "file_path"], "left")
    vocabulary = F.greatest(F.col("distinct_operators") + F.col("distinct_operands"), F.lit(2))
    volume = (F.col("operators") + F.col("operands")) * F.log2(vocabulary)
    raw = (
        F.lit(171) - F.lit(5.2) * F.log(F.greatest(volume, F.lit(1.0)))
        - F.lit(0.23) * F.coalesce(F.col("mean_complexity"), F.lit(1.0))
        - F.lit(16.2) * F.log(F.greatest(F.col("lines_of_code"), F.lit(1)))
    )
    index = sc.round_half_even(sc.clamp(raw * 100 / 171, 0.0, 100.0))
    return joined.select("repository_id", "file_path", index.alias("maintainability"))


def maintainability(halstead: DataFrame, complexity: DataFrame, files: DataFrame) -> DataFrame:
    """Rounded mean of the file indexes; 100 where no file has one."""
    scored = file_maintainability(halstead, complexity, files).groupBy("repository_id").agg(
        sc.round_half_even(F.avg("maintainability")).alias("maintainability_score"))
    repositories = files.select("repository_id").distinct()
    return repositories.join(scored, "repository_id", "left").select(
        "repository_id", F.coalesce("maintainability_score", F.lit(100)).cast("int").alias("maintainability_score"))


def modularity(edges: DataFrame, files: DataFrame) -> DataFrame:
    """100 less four times the mean in plus out degree over all files.

    Summed over files of the repository, degrees are edge ends inside it, so
    no per-file table is needed: each edge adds one per end that is a file.
    """
    counts = files.groupBy("repository_id").agg(F.count("*").alias("files"))
    ends = edges.select("repository_id", F.explode(F.array("src", "dst")).alias("path")).join(
        files.select("repository_id", "path"), ["repository_id", "path"], "left_semi")
    degree = ends.groupBy("repository_id").agg(F.count("*").alias("degree"))
    mean = F.coalesce(F.col("degree"), F.lit(0)) / F.col("files")
    score = sc.clamp(sc.round_half_even(F.lit(100) - mean * 4), 0, 100)
    return counts.join(degree, "repository_id", "left").select("repository_id", score.alias("modularity_score"))


def health_scores(
    findings: DataFrame, files: DataFrame, maintainability: DataFrame, modularity: DataFrame,
    documentation: DataFrame, complexity: DataFrame,
) -> DataFrame:
    """All eleven scores per repository; absent parts count as 100."""
    counts = files.groupBy("repository_id").agg(F.count("*").alias("_files"))
    joined = counts.join(penalty_scores(findings), "repository_id", "left")
    for part in (maintainability, modularity, documentation, complexity):
        joined = joined.join(part, "repository_id", "left")
    names = [*CATEGORY_SCORES, *TYPE_SCORES, "maintainability", "modularity", "documentation", "complexity"]
    filled = joined.withColumns({f"{n}_score": F.coalesce(f"{n}_score", F.lit(100)).cast("int") for n in names})
    filled = filled.withColumn("technical_debt_score", debt_score(F.col("penalty"), F.col("_files")).cast("int"))
    total = sum((F.col(f"{name}_score") for name in OVERALL_PARTS[1:]), F.col(f"{OVERALL_PARTS[0]}_score"))
    return filled.withColumn("overall_score", sc.round_half_even(total / len(OVERALL_PARTS))).select(
        "repository_id", "overall_score", *[f"{n}_score" for n in (
            "architecture", "security", "performance", "maintainability", "scalability", "modularity", "layering",
            "documentation", "complexity", "technical_debt")])
