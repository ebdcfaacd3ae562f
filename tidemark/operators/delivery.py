"""Delivery tables: upserts, cleaning of raw API rows, deployments, CI, lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.findings import paged
from tidemark.operators.keyed import first_per_key, top_per_key
from tidemark.schemas import METRIC_RESPONSE

# Listing limits.
COMMIT_LIST, DIFF_FILES, PATCH_CHARS, ISSUE_COMMENTS = 100, 50, 2000, 20

# Workflow conclusions that mean a failed deployment.
FAILED_CONCLUSIONS = ["failure", "timed_out", "startup_failure"]


# --- upserts --------------------------------------------------------------------------

def _by_content(rows: DataFrame) -> list[Column]:
    """An order that depends on what the rows hold and on nothing else."""
    return [F.to_json(F.struct(*[F.col(c) for c in rows.columns]))]


def upsert(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
    keep_null: Sequence[str] = (), newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """Rows of `target` with `columns` taken from matching updates, plus new rows.

    Keys compare null-safe. `columns` defaults to every column that is not a
    key; columns in `keep_null` keep the old value when the update has none.
    Several updates of one key reduce to the first by `newest_first`, else by
    their content. One shuffle per side, on the key.
    """
    values = [c for c in target.columns if c not in keys]
    changed = set(values if columns is None else columns)
    order = list(newest_first) if newest_first else _by_content(updates)
    once = first_per_key(updates, keys, order)
    old = target.withColumn("_old", F.lit(True)).alias("t")
    new = once.withColumn("_new", F.lit(True)).alias("u")
    same = reduce(lambda a, c: a & c, [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys])
    joined = old.join(new, same, "full_outer")
    was, came = F.col("t._old").isNotNull(), F.col("u._new").isNotNull()
    picked = [F.when(was, F.col(f"t.{k}")).otherwise(F.col(f"u.{k}")).alias(k) for k in keys]
    for name in values:
        stored = F.col(f"t.{name}")
        offered = F.col(f"u.{name}") if name in updates.columns else F.lit(None)
        value = F.coalesce(offered, stored) if name in keep_null else offered
        kept = F.when(came, value).otherwise(stored) if name in changed else stored
        picked.append(F.when(was, kept).otherwise(offered).alias(name))
    return joined.select(*picked).select(*target.columns)


def insert_new(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """`target` plus the rows whose key it lacks, nulls in keys being alike; stored rows never change."""
    once = first_per_key(rows, keys, list(order) if order else _by_content(rows)).alias("u")
    same = reduce(lambda a, c: a & c, [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys])
    fresh = once.join(target.select(*keys).alias("t"), same, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


# --- raw rows -------------------------------------------------------------------------

def branch_tips(branches: DataFrame, commits: DataFrame) -> DataFrame:
    """Branches with the time of their tip commit, null when it is not synced."""
    tips = commits.select("repository_id", F.col("sha").alias("last_commit_sha"), F.col("committed_at").alias("last_commit_at"))
    return branches.join(tips, ["repository_id", "last_commit_sha"], "left")


def pr_state(merged_at: Column, state: Column) -> Column:
    return F.when(merged_at.isNotNull(), "MERGED").when(state == "open", "OPEN").otherwise("CLOSED")


def clean_issues(raw: DataFrame) -> DataFrame:
    """API issues without pull requests; labels reduced to non-empty names.

    `labels` is an array of JSON values: plain texts or objects with a name.
    """
    def name(label: Column) -> Column:
        return F.when(label.startswith("{"), F.get_json_object(label, "$.name")).otherwise(F.trim(label, F.lit('"')))

    labels = F.filter(F.transform("labels", name), lambda x: F.coalesce(x, F.lit("")) != "")
    return (
        raw.filter(F.col("pull_request").isNull())
        .withColumn("labels", labels).drop("pull_request")
        .withColumn("state", F.when(F.col("state") == "open", "OPEN").otherwise("CLOSED"))
        .withColumn("author_login", F.coalesce("author_login", F.lit("unknown")))
    )


def clean_commits(raw: DataFrame) -> DataFrame:
    return raw.withColumn("author_name", F.coalesce("author_name", F.lit("Unknown"))).withColumn(
        "author_email", F.coalesce("author_email", F.lit("unknown@example.com")))


def clean_repositories(raw: DataFrame) -> DataFrame:
    flag = F.when(F.col("private"), "private").otherwise("public")
    return raw.withColumn("visibility", F.upper(F.coalesce("visibility", flag))).drop("private")


def deployment_status(status: Column, conclusion: Column) -> Column:
    """A run that is not completed is in progress; only failures fail."""
    return (
        F.when(status != "completed", "IN_PROGRESS")
        .when(conclusion.isin(FAILED_CONCLUSIONS), "FAILED")
        .otherwise("SUCCESS")
    )


def runs_to_deployments(runs: DataFrame, since: Column) -> DataFrame:
    """Workflow runs created at or after `since`, as deployments."""
    kept = [c for c in ("organization_id", "service_id", "repository_id") if c in runs.columns]
    return runs.filter(F.col("created_at") >= since).select(
        *kept, F.col("id").cast("string").alias("source_run_id"), F.substring("head_sha", 1, 7).alias("version"),
        F.col("head_branch").alias("environment"), deployment_status(F.col("status"), F.col("conclusion")).alias("status"),
        F.coalesce("run_started_at", "created_at").alias("deployed_at"), F.col("head_sha").alias("commit_sha"),
        "conclusion")


def parse_metrics(responses: DataFrame) -> DataFrame:
    return responses.withColumn("_body", F.from_json("body", METRIC_RESPONSE))


def flatten_metrics(responses: DataFrame) -> DataFrame:
    """Metric bodies as points: every point of a matrix, the first of a vector."""
    kept = [c for c in responses.columns if c != "body"]
    ok = parse_metrics(responses).filter("_body.status = 'success'")
    is_matrix = F.col("_body.data.resultType") == "matrix"
    series = F.when(is_matrix, F.col("_body.data.result")).otherwise(F.slice("_body.data.result", 1, 1))
    one = ok.select(*kept, F.posexplode(series).alias("series", "_s"))
    points = F.coalesce(F.col("_s.values"), F.array("_s.value"))
    flat = one.select(*kept, "series", F.col("_s.metric").alias("labels"), F.explode(points).alias("_p"))
    return flat.select(
        *kept, "series", "labels", F.timestamp_seconds(F.col("_p")[0].cast("double")).alias("ts"),
        F.col("_p")[1].cast("double").alias("value"))


def metric_errors(responses: DataFrame) -> DataFrame:
    """Bodies that are not a success, with what they say."""
    parsed = parse_metrics(responses)
    bad = F.coalesce(F.col("_body.status") != "success", F.lit(True))
    return parsed.filter(bad).withColumn("error", F.coalesce("_body.error", F.lit("unreadable body"))).drop("_body")


def pr_details(raw: DataFrame) -> DataFrame:
    """The fields of a pull request that reviews use, from its JSON `body`."""
    shape = (
        "number int, title string, body string, state string, draft boolean, user struct<login:string>, "
        "base struct<ref:string,sha:string>, head struct<ref:string,sha:string>, additions int, deletions int, "
        "changed_files int, commits int, mergeable boolean, mergeable_state string, html_url string")
    p = F.col("_p")
    return raw.withColumn("_p", F.from_json("body", shape)).select(
        "repository_id", p["number"].alias("number"), p["title"].alias("title"), p["body"].alias("body"),
        p["state"].alias("state"), p["draft"].alias("is_draft"), p["user"]["login"].alias("author"),
        p["base"]["ref"].alias("base_ref"), p["base"]["sha"].alias("base_sha"), p["head"]["ref"].alias("head_ref"),
        p["head"]["sha"].alias("head_sha"), p["additions"].alias("additions"), p["deletions"].alias("deletions"),
        p["changed_files"].alias("changed_files"), p["commits"].alias("commits"), p["mergeable"].alias("mergeable"),
        p["mergeable_state"].alias("mergeable_state"), p["html_url"].alias("html_url"))


def issue_details(raw: DataFrame) -> DataFrame:
    """An issue with flat labels and its first twenty comments."""
    shape = "number int, title string, body string, state string, user struct<login:string>, labels array<string>, comments int, html_url string"
    comments = "array<struct<user:struct<login:string>, body:string, created_at:string>>"
    i = F.col("_i")
    label = F.transform(i["labels"], lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
    first = F.slice(F.from_json("comments", comments), 1, ISSUE_COMMENTS)
    recent = F.transform(first, lambda c: F.struct(
        c["user"]["login"].alias("author"), c["body"].alias("body"), c["created_at"].alias("created_at")))
    return raw.withColumn("_i", F.from_json("body", shape)).select(
        "repository_id", i["number"].alias("number"), i["title"].alias("title"), i["body"].alias("body"),
        i["state"].alias("state"), i["user"]["login"].alias("author"), label.alias("labels"),
        i["comments"].alias("comment_count"), i["html_url"].alias("html_url"), recent.alias("recent_comments"))


# --- CI and diffs ---------------------------------------------------------------------

def ci_rollup(commits: DataFrame, check_runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per commit: failing, pending_or_unknown or passing.

    Both report tables reduce to two flags per commit map-side, so a commit
    with very many reports costs one row per task.
    """
    keys = ["repository_id", "sha"]
    runs = check_runs.select(
        *keys, F.coalesce(F.col("conclusion").isin("failure", "timed_out"), F.lit(False)).alias("failed"),
        F.coalesce(F.col("status") != "completed", F.lit(False)).alias("pending"))
    states = statuses.select(
        *keys, F.coalesce(F.col("state").isin("failure", "error"), F.lit(False)).alias("failed"),
        F.coalesce(F.col("state") == "pending", F.lit(False)).alias("pending"))
    reports = runs.unionByName(states).groupBy(*keys).agg(
        F.bool_or("failed").alias("failed"), F.bool_or("pending").alias("pending"), F.count("*").alias("reports"))
    joined = commits.select(*keys).join(reports, keys, "left")
    overall = (
        F.when(F.col("failed"), "failing").when(F.col("pending") | F.col("reports").isNull(), "pending_or_unknown")
        .otherwise("passing"))
    return joined.select(*keys, overall.alias("overall"), F.coalesce("reports", F.lit(0)).alias("reports"))


def pr_diff(pr_files: DataFrame, keys: Sequence[str] = ("repository_id", "number")) -> DataFrame:
    """The first fifty files of each pull request, patches cut, with the total."""
    keys = list(keys)
    totals = pr_files.groupBy(*keys).agg(F.count("*").alias("total_files"))
    first = top_per_key(pr_files, keys, [F.col("position").asc(), F.col("filename").asc()], DIFF_FILES)
    return first.join(totals, keys).withColumn("patch", tx.clip(F.col("patch"), PATCH_CHARS)).withColumn(
        "truncated", F.col("total_files") > DIFF_FILES)


# --- lists ----------------------------------------------------------------------------

def list_branches(branches: DataFrame) -> DataFrame:
    return branches.orderBy("repository_id", "name")


def recent_commits(commits: DataFrame, k: int = COMMIT_LIST) -> DataFrame:
    return top_per_key(commits, ["repository_id"], [F.col("committed_at").desc(), F.col("sha").asc()], k, rank="position")


def list_contributors(contributors: DataFrame) -> DataFrame:
    return contributors.orderBy("repository_id", F.col("contributions").desc(), "login")


def list_by_creation(rows: DataFrame, created: str = "created_at", tie: str = "number") -> DataFrame:
    """Pull requests or issues, newest first."""
    return rows.orderBy("repository_id", F.col(created).desc(), F.col(tie).desc())


def list_repositories(
    repositories: DataFrame, search: str | None = None, language: str | None = None, sort: str | None = None,
) -> DataFrame:
    rows = repositories
    if search:
        rows = rows.filter(F.contains(F.lower("name"), F.lit(search.lower())))
    if language:
        rows = rows.filter(F.col("primary_language") == language)
    order = {
        "name": F.col("name").asc(), "stars": F.col("stars_count").desc(), "updated": F.col("pushed_at").desc_nulls_first(),
    }.get(sort, F.col("created_at").desc())
    return rows.orderBy(order, "id")


def importable(available: DataFrame, imported: DataFrame) -> DataFrame:
    """Repositories on offer, each with whether it is imported already."""
    known = imported.select("github_repo_id").distinct().withColumn("_known", F.lit(True))
    return available.join(known, "github_repo_id", "left").withColumn(
        "already_imported", F.col("_known").isNotNull()).drop("_known")


def new_repositories(available: DataFrame, imported: DataFrame) -> DataFrame:
    return available.join(imported.select("github_repo_id"), "github_repo_id", "left_anti")


def list_deployments(
    deployments: DataFrame, service_id: str | None = None, environment: str | None = None, status: str | None = None,
    page: int = 1, page_size: int = 20,
) -> DataFrame:
    rows = deployments
    for name, value in (("service_id", service_id), ("environment", environment), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return paged(rows, [F.col("deployed_at").desc(), F.col("id").asc()], page, page_size)
