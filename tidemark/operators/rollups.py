"""Dashboard rollups, task tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as sc
from tidemark.operators.findings import SCORE_CATEGORY, paged, scores_long
from tidemark.operators.keyed import top_per_key

# Window lengths, list lengths, thresholds, statuses.
ACTIVITY_DAYS, TOP_CONTRIBUTORS, WEAKEST, REPORT_FINDINGS = 14, 8, 3, 500
HEALTHY_SCORE = 60
TASK_STATUSES = ["QUEUED", "RUNNING", "PENDING_APPROVAL", "COMPLETED", "FAILED", "CANCELLED"]
ACTIVE_TASKS = ["QUEUED", "RUNNING", "PENDING_APPROVAL"]
ACTIVE_INCIDENTS = ["DETECTED", "INVESTIGATING"]

# Report labels of the scores, in order.
SCORE_LABELS = {
    "Overall": "overall", "Architecture": "architecture", "Security": "security", "Performance": "performance",
    "Maintainability": "maintainability", "Scalability": "scalability", "Modularity": "modularity", "Layering": "layering",
    "Documentation": "documentation", "Complexity": "complexity", "Technical Debt": "technical_debt",
}


# --- repositories ---------------------------------------------------------------------

def commit_activity(commits: DataFrame, days: int = ACTIVITY_DAYS) -> DataFrame:
    """Commits per UTC day, over each repository's last `days` days that have any."""
    daily = commits.groupBy("repository_id", F.to_date("committed_at").alias("day")).agg(F.count("*").alias("commits"))
    return top_per_key(daily, ["repository_id"], [F.col("day").desc()], days)


def top_contributors(contributors: DataFrame, k: int = TOP_CONTRIBUTORS) -> DataFrame:
    return top_per_key(contributors, ["repository_id"], [F.col("contributions").desc(), F.col("login").asc()], k, rank="position")


def languages(repositories: DataFrame, column: str = "primary_language") -> DataFrame:
    return repositories.select(F.col(column).alias("language")).filter("language IS NOT NULL").distinct().orderBy("language")


# --- health ---------------------------------------------------------------------------

def weakest_scores(analyses: DataFrame, k: int = WEAKEST) -> DataFrame:
    """The lowest scores of each analysis apart from the overall one, unknown ones left out."""
    long = scores_long(analyses).filter("score_name <> 'overall' AND score IS NOT NULL")
    place = sc.lookup(F.col("score_name"), {name: i for i, name in enumerate(SCORE_CATEGORY)})
    return top_per_key(long, ["id"], [F.col("score").asc(), place.asc()], k, rank="position")


def health_headline(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """What to look at first: critical findings, else high ones, else a low overall score."""
    counts = findings.groupBy("analysis_id").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("_critical"), F.count_if(F.col("severity") == "HIGH").alias("_high"))
    joined = analyses.select(F.col("id").alias("analysis_id"), "repository_id", "overall_score").join(counts, "analysis_id", "left")
    critical, high = F.coalesce("_critical", F.lit(0)), F.coalesce("_high", F.lit(0))

    def several(n: Column) -> Column:
        return F.when(n == 1, "").otherwise("s")

    headline = (
        F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical issue"), several(critical), F.lit(" need attention")))
        .when(high > 0, F.concat(high.cast("string"), F.lit(" high-severity issue"), several(high), F.lit(" to review")))
        .when(F.col("overall_score") < HEALTHY_SCORE, "Overall score is below a healthy threshold")
        .otherwise("No critical issues found"))
    tone = F.when(critical > 0, "danger").when((high > 0) | (F.col("overall_score") < HEALTHY_SCORE), "warning").otherwise("success")
    return joined.select("analysis_id", "repository_id", tone.alias("tone"), headline.alias("headline"))


# --- incidents and tasks --------------------------------------------------------------

def incident_tiles(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Per organization: active incidents, those that are critical, and services."""
    active = F.col("status").isin(ACTIVE_INCIDENTS)
    counts = incidents.groupBy("organization_id").agg(
        F.count_if(active).alias("active_incidents"),
        F.count_if(active & (F.col("severity") == "CRITICAL")).alias("critical_incidents"))
    owned = services.groupBy("organization_id").agg(F.count("*").alias("services"))
    return counts.join(owned, "organization_id", "full_outer").fillna(0)


def task_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per organization and status, zeros included, and the number active and in all."""
    counts = tasks.groupBy("organization_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATUSES],
        F.count_if(F.col("status").isin(ACTIVE_TASKS)).alias("_active"), F.count_if(F.col("status").isin(TASK_STATUSES)).alias("_total"))
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("tasks")) for s in TASK_STATUSES],
                    F.struct(F.lit("ACTIVE").alias("status"), F.col("_active").alias("tasks")),
                    F.struct(F.lit("TOTAL").alias("status"), F.col("_total").alias("tasks")))
    return counts.select("organization_id", F.inline(pairs))


def list_tasks(
    tasks: DataFrame, status: str | None = None, repository_id: str | None = None, workflow_key: str | None = None,
    pr_number: int | None = None, issue_number: int | None = None, page: int = 1, page_size: int = 20,
) -> DataFrame:
    """Tasks newest first; the numbers sit inside the JSON parameters."""
    rows = tasks
    for name, value in (("status", status), ("repository_id", repository_id), ("workflow_key", workflow_key)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    for name, value in (("prNumber", pr_number), ("issueNumber", issue_number)):
        if value is not None:
            rows = rows.filter(F.get_json_object("workflow_params", f"$.{name}") == F.lit(str(value)))
    return paged(rows, [F.col("created_at").desc(), F.col("id").asc()], page, page_size)


def execution_trace(executions: DataFrame, logs: DataFrame, validations: DataFrame, calls: DataFrame) -> DataFrame:
    """Executions in step order, each with its logs, validations and tool calls nested.

    One row per execution; what hangs on one is limited by its tool rounds.
    """
    def nested(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
        return df.groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    rows = executions
    for df, name, fields in (
        (logs, "logs", ["created_at", "message"]), (validations, "validations", ["position", "passed"]),
        (calls, "tool_invocations", ["position", "tool_name", "status"]),
    ):
        rows = rows.join(nested(df, name, fields), "execution_id", "left")
    return rows.orderBy("task_id", "step_index", "execution_id")


def task_progress(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Finished steps over all steps of the plan, in rounded percent.

    A step is finished once it has a completed or skipped execution; the
    distinct count reduces map-side.
    """
    done = executions.filter(F.col("status").isin("COMPLETED", "SKIPPED")).groupBy("task_id").agg(
        F.count_distinct("agent_key").alias("done"))
    steps = tasks.select(F.col("id").alias("task_id"), F.col("step_count"))
    share = F.try_divide(F.coalesce("done", F.lit(0)), F.col("step_count")) * 100
    return steps.join(done, "task_id", "left").select(
        "task_id", F.coalesce("done", F.lit(0)).alias("done"), "step_count", sc.round_half_up(share).alias("progress"))


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool: calls, share that failed, and duration percentiles.

    Durations are whole milliseconds, so calls first reduce to one row per
    tool and duration; the exact percentile then weighs those rows.
    """
    per_duration = calls.groupBy("tool_name", "duration_ms").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return per_duration.groupBy("tool_name").agg(
        F.sum("n").alias("calls"), (F.sum("failed") / F.sum("n")).alias("failure_share"),
        F.expr("percentile(duration_ms, 0.5, n)").alias("p50_ms"), F.expr("percentile(duration_ms, 0.95, n)").alias("p95_ms"))


# --- reports --------------------------------------------------------------------------

def _report_findings(findings: DataFrame, k: int = REPORT_FINDINGS) -> DataFrame:
    order = [sc.severity_rank(F.col("severity")).desc(), F.col("created_at").asc(), F.col("id").asc()]
    return top_per_key(findings, ["analysis_id"], order, k, rank="_place")


def _per_analysis(entries: DataFrame, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("_place"), value.alias("v")))), lambda e: e["v"])


def json_report(analyses: DataFrame, repositories: DataFrame, findings: DataFrame, k: int = REPORT_FINDINGS) -> DataFrame:
    """One JSON document per analysis: repository, scores, summary, up to `k` findings."""
    entry = F.struct("id", "category", "type", "severity", "confidence", "title", "file_path")
    chosen = _report_findings(findings, k)
    listed = chosen.groupBy("analysis_id").agg(_per_analysis(chosen, entry).alias("findings"))
    names = repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("_name"))
    joined = analyses.withColumnRenamed("id", "analysis_id").join(names, "repository_id").join(listed, "analysis_id", "left")
    scores = F.struct(*[F.col(f"{key}_score").alias(key) for key in SCORE_LABELS.values()])
    report = F.struct(
        F.struct(F.col("repository_id").alias("id"), F.col("_name").alias("name")).alias("repository"),
        F.col("analysis_id"), scores.alias("scores"), F.col("architecture_summary"),
        F.coalesce("findings", F.array().cast(listed.schema["findings"].dataType)).alias("findings"))
    return joined.select("analysis_id", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def markdown_report(analyses: DataFrame, repositories: DataFrame, findings: DataFrame, k: int = REPORT_FINDINGS) -> DataFrame:
    """One markdown text per analysis: score table, summary, findings."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- **{label}**: "), value))

    place = F.when(F.coalesce("start_line", F.lit(0)) != 0, F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"))).otherwise(F.col("file_path"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("### ["), "severity", F.lit("] "), "title"), F.lit(""),
        F.concat(F.lit("- **Category**: "), "category", F.lit(" / "), "type"),
        F.concat(F.lit("- **Priority**: "), F.coalesce("priority", "severity")),
        F.concat(F.lit("- **Confidence**: "), F.col("confidence").cast("string"), F.lit("%")),
        F.when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit("- **Location**: "), place)),
        F.concat(F.lit("- **Explanation**: "), "explanation"), line("Evidence", F.col("evidence")),
        line("Suggested Fix", F.col("suggested_fix")), line("Estimated Impact", F.col("estimated_impact")),
        F.when(F.size("related_files") > 0, F.concat(F.lit("- **Related Files**: "), F.array_join("related_files", ", "))), F.lit(""))
    chosen = _report_findings(findings, k)
    listed = chosen.groupBy("analysis_id").agg(F.array_join(_per_analysis(chosen, block), "\n").alias("_findings"))
    names = repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("_name"))
    joined = analyses.withColumnRenamed("id", "analysis_id").join(names, "repository_id").join(listed, "analysis_id", "left")
    stamp = F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = [
        F.concat(F.lit(f"| {label} | "), F.coalesce(F.col(f"{key}_score").cast("string"), F.lit("N/A")), F.lit(" |"))
        for label, key in SCORE_LABELS.items()]
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Engineering Analysis Report: "), "_name"), F.lit(""),
        F.concat(F.lit("Analysis completed: "), F.coalesce(stamp, F.lit("N/A"))), F.lit(""), F.lit("## Scores"), F.lit(""),
        F.lit("| Metric | Score |"), F.lit("| --- | --- |"), *rows, F.lit(""), F.lit("## Architecture Summary"), F.lit(""),
        F.coalesce("architecture_summary", F.lit("Not available.")), F.lit(""), F.lit("## Findings"), F.lit(""),
        F.coalesce("_findings", F.lit("No findings.")))
    return joined.select("analysis_id", text.alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines of (analysis_id, report)."""
    reports.write.mode("overwrite").json(path)
