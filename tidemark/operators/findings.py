"""Findings as a table: confirming, scoping, ranking, listing, explaining."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores as sc, text as tx
from tidemark.operators.keyed import salted_join, top_per_key

# Candidate categories, snippet size, statuses of running work.
CANDIDATE_CATEGORIES = ("SOLID", "PATTERN")
SNIPPET_CHARS = 3000
ACTIVE_ANALYSIS = ("PENDING", "RUNNING")
ACTIVE_TASK = ("QUEUED", "RUNNING", "PENDING_APPROVAL")

# Top-k sizes of the three consumers.
HEALTH_REPORT_K, REVIEW_K, EXPLAIN_K = 15, 25, 10

# The finding category behind each score; None takes all.
SCORE_CATEGORY = {
    "overall": None, "architecture": "DEPENDENCY", "security": "SECURITY", "performance": "PERFORMANCE",
    "maintainability": "QUALITY", "scalability": "PERFORMANCE", "modularity": "DEPENDENCY", "layering": "DEPENDENCY",
    "documentation": "QUALITY", "complexity": "QUALITY", "technical_debt": None,
}


def run_rules(
    rules: dict[str, Callable[[], DataFrame]], materialise: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of all rules that build; the second value names those that do not.

    A lazy plan only fails when it runs. Pass `materialise` (for example a
    checkpoint) to run each rule by itself and leave out those that fail then.
    """
    merged: DataFrame | None = None
    failed: dict[str, str] = {}
    for name, build in rules.items():
        try:
            rows = build()
            if materialise is not None:
                rows = materialise(rows)
        except Exception as error:  # noqa: BLE001 - one bad rule must not stop the others
            failed[name] = f"{type(error).__name__}: {error}"
            continue
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    return merged, failed


def apply_verdicts(
    findings: DataFrame, verdicts: DataFrame | None, candidates: Sequence[str] = CANDIDATE_CATEGORIES,
) -> DataFrame:
    """Keeps a candidate only where its verdict confirms it.

    `verdicts` has one row per finding id: confirmed, confidence, explanation,
    suggested_fix. A verdict's text and confidence replace the finding's.
    """
    is_candidate = F.col("category").isin(*candidates)
    others = findings.filter(~is_candidate)
    if verdicts is None:
        return others
    answers = verdicts.filter("confirmed").select(
        "id", F.col("confidence").alias("_confidence"), F.col("explanation").alias("_explanation"),
        F.col("suggested_fix").alias("_fix"))
    confirmed = (
        findings.filter(is_candidate).join(answers, "id")
        .withColumn("confidence", F.coalesce("_confidence", "confidence"))
        .withColumn("explanation", F.coalesce(tx.non_empty(F.col("_explanation")), "explanation"))
        .withColumn("suggested_fix", F.col("_fix"))
        .select(*findings.columns)
    )
    return others.unionByName(confirmed)


def finding_snippets(findings: DataFrame, files: DataFrame, limit: int = SNIPPET_CHARS) -> DataFrame:
    """The finding's lines, or the start of the file without a range, cut to `limit`."""
    joined = _with_source(findings, files, {
        "_lines": tx.text_lines(F.col("content")), "_head": tx.clip(F.col("content"), limit)})
    whole = F.col("start_line").isNull() | F.col("end_line").isNull()
    text = F.when(whole, F.col("_head")).otherwise(
        tx.line_slice(F.col("_lines"), F.col("start_line"), F.col("end_line")))
    return joined.withColumn("snippet", tx.clip(F.coalesce(text, F.lit("")), limit)).drop("_lines", "_head")


def finding_context(findings: DataFrame, files: DataFrame, around: int = 2) -> DataFrame:
    """The finding's lines with `around` more on both sides, as `current_source`."""
    joined = _with_source(findings, files, {"_lines": F.split("content", "\n")})
    lines = F.col("_lines")
    first = F.coalesce("start_line", F.lit(1)) - around
    last = F.least(F.coalesce(F.col("end_line"), F.size(lines)) + around, F.size(lines))
    return joined.withColumn("current_source", tx.line_slice(lines, first, last)).drop("_lines")


def _with_source(findings: DataFrame, files: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Findings with columns cut from their file.

    Lines are split once per file, ahead of the join; only files that have
    findings are shuffled.
    """
    wanted = findings.select("repository_id", "file_path").distinct()
    sources = files.select(
        "repository_id", F.col("path").alias("file_path"), *[c.alias(n) for n, c in columns.items()]
    ).join(wanted, ["repository_id", "file_path"], "left_semi")
    return findings.join(sources, ["repository_id", "file_path"], "left")


def scope_to_changes(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose file or any related file is in `changed` (repository_id, path)."""
    files = F.array_distinct(F.array_compact(F.concat(
        F.array("file_path"), F.coalesce("related_files", F.array().cast("array<string>")))))
    touched = (
        findings.select("repository_id", "id", F.explode(files).alias("path"))
        .join(changed.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_semi")
        .select("id").distinct()
    )
    return findings.join(touched, "id", "left_semi")


def _by_severity() -> list[Column]:
    return [sc.severity_rank(F.col("severity")).desc(), F.col("created_at").asc(), F.col("id").asc()]


def top_findings(findings: DataFrame, k: int = HEALTH_REPORT_K, keys: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """The `k` most severe findings per key, oldest first among equals."""
    return top_per_key(findings, list(keys), _by_severity(), k, rank="position")


def list_findings(
    findings: DataFrame, category: str | None = None, severity: str | None = None, priority: str | None = None,
    sort_by: str = "severity", descending: bool = True, page: int = 1, page_size: int = 20,
) -> DataFrame:
    """One page of filtered findings with the total of all that match."""
    rows = findings
    for name, value in (("category", category), ("severity", severity), ("priority", priority)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    key = {
        "severity": sc.severity_rank(F.col("severity")),
        "priority": sc.severity_rank(F.coalesce("priority", "severity")),
        "confidence": F.col("confidence"),
        "created_at": F.col("created_at"),
    }[sort_by]
    return paged(rows, [key.desc() if descending else key.asc(), F.col("id").asc()], page, page_size)


def paged(rows: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """Page `page` of `rows` with the total count and number of pages on each row.

    The page is a top-k of page * size rows; the total is a scalar subquery.
    """
    total = rows.agg(F.count("*").alias("n")).scalar()
    return (
        rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
        .withColumn("total_count", total)
        .withColumn("total_pages", sc.page_count(F.col("total_count"), page_size))
    )


def all_findings(findings: DataFrame, category: str | None = None) -> DataFrame:
    rows = findings if category is None else findings.filter(F.col("category") == category)
    return rows.orderBy(*_by_severity())


def latest_analysis(analyses: DataFrame, completed_only: bool = True) -> DataFrame:
    """The newest analysis per repository, by default of the completed ones."""
    rows = analyses.filter("status = 'COMPLETED'") if completed_only else analyses
    return top_per_key(rows, ["repository_id"], [F.col("started_at").desc(), F.col("id").asc()], 1)


def analysis_history(analyses: DataFrame, repository_id: str, page: int = 1, page_size: int = 20) -> DataFrame:
    rows = analyses.filter((F.col("repository_id") == repository_id) & (F.col("status") == "COMPLETED"))
    return paged(rows, [F.col("started_at").desc(), F.col("id").asc()], page, page_size)


def score_trend(analyses: DataFrame, n: int, score: str = "overall_score") -> DataFrame:
    """The last `n` completed analyses per repository, oldest first, with the change."""
    recent = top_per_key(
        analyses.filter("status = 'COMPLETED'"), ["repository_id"], [F.col("started_at").desc(), F.col("id").asc()], n,
        rank="_newest")
    in_time = Window.partitionBy("repository_id").orderBy(F.col("_newest").desc())
    return (
        recent.withColumn("position", F.row_number().over(in_time))
        .withColumn("change", F.col(score) - F.lag(score).over(in_time)).drop("_newest")
    )


def scores_long(analyses: DataFrame) -> DataFrame:
    """One row per analysis and score name."""
    columns = [f"{name}_score" for name in SCORE_CATEGORY]
    long = analyses.unpivot(["id", "repository_id"], columns, "score_name", "score")
    return long.withColumn("score_name", F.regexp_replace("score_name", "_score$", ""))


def explain_scores(analyses: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per repository's latest analysis and score: its value, category and how
    many findings stand behind it; and the ten gravest of those findings."""
    latest = latest_analysis(analyses)
    long = scores_long(latest).withColumnRenamed("id", "analysis_id")
    category = F.coalesce(sc.lookup(F.col("score_name"), {k: v for k, v in SCORE_CATEGORY.items() if v}), F.lit("*"))
    long = long.withColumn("category", category)
    mine = salted_join(findings, latest.select(F.col("id").alias("analysis_id")), ["analysis_id"], ["id"], "left_semi")
    labelled = mine.select("*", F.explode(F.array("category", F.lit("*"))).alias("_group"))
    counts = mine.groupBy("analysis_id", "category").agg(F.count("*").alias("n"))
    with_all = counts.unionByName(
        counts.groupBy("analysis_id").agg(F.sum("n").alias("n")).withColumn("category", F.lit("*")))
    summary = long.join(with_all, ["analysis_id", "category"], "left").select(
        "repository_id", "analysis_id", "score_name", "score",
        F.when(F.col("category") != "*", F.col("category")).alias("category"),
        F.coalesce("n", F.lit(0)).alias("contributing_findings"))
    top = top_per_key(labelled, ["analysis_id", "_group"], _by_severity(), EXPLAIN_K, rank="position")
    return summary, top.withColumnRenamed("_group", "score_category")


def pattern_instances(findings: DataFrame, name: str, category: str = "PATTERN") -> DataFrame:
    return findings.filter((F.col("category") == category) & (F.lower("type") == name.lower()))


def active_conflicts(jobs: DataFrame, key: str, statuses: Sequence[str] = ACTIVE_ANALYSIS) -> DataFrame:
    """Keys with more than one active job."""
    return (
        jobs.filter(F.col("status").isin(*statuses)).groupBy(key).agg(F.count("*").alias("active"))
        .filter("active > 1")
    )
