"""Upserts, deployments, CI and lists over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import delivery as dl
from tidemark.plans import bindings as b
from tidemark.plans.registry import add

# --- upserts over two versions of the documents ----------------------------------------


def versions(spark, sf):
    """Stored rows and twice-delivered updates; every ninth update has no note."""
    previous, current = b.snapshots(spark, sf)
    n = F.col("path").cast("bigint")
    stored = previous.select("repository_id", "path", "content_hash", F.concat(F.lit("old "), "path").alias("note"),
                             F.lit("first").alias("origin"))
    new = current.select("repository_id", "path", "content_hash", F.when(n % 9 != 0, F.concat(F.lit("new "), "path")).alias("note"),
                         F.lit("second").alias("origin"))
    stale = new.withColumn("note", F.lit("stale")).withColumn("seq", F.lit(1))
    return stored, new.withColumn("seq", F.lit(2)).unionByName(stale)


SHOWN = ["repository_id", "path", "content_hash", "note", "origin"]
b.CTES["ver_old"] = "SELECT repository_id, path, content_hash, 'old ' || path AS note, 'first' AS origin FROM snap_prev"
b.CTES["ver_new"] = """
SELECT repository_id, path, content_hash, CASE WHEN path::BIGINT % 9 <> 0 THEN 'new ' || path END AS note,
       'second' AS origin FROM snap_cur"""


def _upsert(**options):
    def run(spark, sf):
        stored, updates = versions(spark, sf)
        return dl.upsert(stored, updates, ["repository_id", "path"], newest_first=[F.col("seq").desc()], **options).select(*SHOWN)
    return run


add("u1_upsert", _upsert(columns=["content_hash", "note"]), """
SELECT repository_id, path, coalesce(n.content_hash, o.content_hash) AS content_hash,
       CASE WHEN n.path IS NULL THEN o.note ELSE n.note END AS note,
       CASE WHEN o.path IS NULL THEN n.origin ELSE o.origin END AS origin
FROM ver_old o FULL JOIN ver_new n USING (repository_id, path)""")
add("u2_insert_only", lambda spark, sf: dl.insert_new(
    *versions(spark, sf), ["repository_id", "path"], [F.col("seq").desc()]).select(*SHOWN), """
SELECT * FROM ver_old UNION ALL
SELECT * FROM ver_new n WHERE NOT EXISTS (SELECT 1 FROM ver_old o WHERE o.repository_id = n.repository_id AND o.path = n.path)""")
add("u3_keep_old_when_null", _upsert(keep_null=["note"]), """
SELECT repository_id, path, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.note, o.note) AS note,
       coalesce(n.origin, o.origin) AS origin
FROM ver_old o FULL JOIN ver_new n USING (repository_id, path)""")


def _status_upsert(spark, sf):
    """Deployments polled twice; the later poll only moves the status. Every 13th run has no id."""
    rows = b.deployments(spark, sf).select(
        "service_id", F.lit("GITHUB").alias("source_provider"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id").cast("string")).alias("source_run_id"), "status",
        "environment", "event_id")
    first = rows.filter("event_id % 2 = 0").withColumn("environment", F.lit("first"))
    second = rows.withColumn("status", F.lit("SUCCESS"))
    keys = ["service_id", "source_provider", "source_run_id"]
    stored = dl.insert_new(first.limit(0).select(*keys, "status", "environment"), first, keys, [F.col("event_id")])
    return dl.upsert(stored, second, keys, ["status"], newest_first=[F.col("event_id")])


add("u4_status_only", _status_upsert, """
WITH rows AS (SELECT service_id, 'GITHUB' AS source_provider,
                     CASE WHEN event_id % 13 <> 0 THEN event_id::VARCHAR END AS source_run_id, environment, event_id
              FROM deployments_ev),
firsts AS (SELECT * FROM rows WHERE event_id % 2 = 0
           QUALIFY row_number() OVER (PARTITION BY service_id, source_run_id ORDER BY event_id) = 1),
seconds AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY service_id, source_run_id ORDER BY event_id) = 1)
SELECT s.service_id, s.source_provider, s.source_run_id, 'SUCCESS' AS status,
       CASE WHEN f.event_id IS NULL THEN s.environment ELSE 'first' END AS environment
FROM seconds s LEFT JOIN firsts f ON f.service_id = s.service_id AND f.source_run_id IS NOT DISTINCT FROM s.source_run_id""")

# --- raw rows ----------------------------------------------------------------------------


def branches_and_commits(spark, sf):
    orders = b.table(spark, sf, "orders")
    lines = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("committed_at"))
    branches = orders.select(
        F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("repository_id"), F.concat(F.lit("b"), "o_orderkey").alias("name"),
        F.col("o_orderkey").cast("string").alias("last_commit_sha"))
    commits = lines.filter("l_orderkey % 3 <> 0").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("repository_id"), F.col("l_orderkey").cast("string").alias("sha"),
        F.col("committed_at").cast("timestamp"))
    return branches, commits


add("dl1_branch_tips", lambda spark, sf: dl.branch_tips(*branches_and_commits(spark, sf)), """
SELECT 'r' || (o_custkey % 7) AS repository_id, 'b' || o_orderkey AS name, o_orderkey::VARCHAR AS last_commit_sha,
       CASE WHEN o_orderkey % 3 <> 0 THEN (SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o_orderkey) END
         AS last_commit_at
FROM orders""")
add("dl2_pr_state", lambda spark, sf: b.table(spark, sf, "orders").select("o_orderkey", dl.pr_state(
    F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
).alias("state")), """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state FROM orders""")


def raw_issues(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "concat('r', o_custkey % 7) AS repository_id", "CAST(o_orderkey AS int) AS number",
        "CASE WHEN o_orderkey % 4 = 0 THEN '{}' END AS pull_request",
        """array(concat('"', o_orderpriority, '"'), '""', concat('{"name":"', o_orderstatus, '"}'), '{"id":1}') AS labels""",
        "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state",
        "CASE WHEN o_orderkey % 5 <> 0 THEN concat('u', o_custkey) END AS author_login")


add("dl3_clean_issues", lambda spark, sf: dl.clean_issues(raw_issues(spark, sf)).withColumn(
    "labels", F.array_join("labels", "|")), """
SELECT 'r' || (o_custkey % 7) AS repository_id, o_orderkey::INTEGER AS number, o_orderpriority || '|' || o_orderstatus AS labels,
       CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'u' || o_custkey ELSE 'unknown' END AS author_login
FROM orders WHERE o_orderkey % 4 <> 0""")
add("dl4_commit_defaults", lambda spark, sf: dl.clean_commits(b.table(spark, sf, "customer").selectExpr(
    "c_custkey AS sha", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS author_name",
    "CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS author_email")), """
SELECT c_custkey AS sha, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'Unknown' END AS author_name,
       CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'unknown@example.com' END AS author_email FROM customer""")
add("dl4_repository_visibility", lambda spark, sf: dl.clean_repositories(b.table(spark, sf, "customer").selectExpr(
    "c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END AS visibility", "c_acctbal < 0 AS private")), """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_acctbal < 0 THEN 'PRIVATE'
  ELSE 'PUBLIC' END AS visibility FROM customer""")


def workflow_runs(spark, sf):
    return b.table(spark, sf, "orders").selectExpr(
        "concat('s', o_custkey % 20) AS service_id", "o_orderkey AS id", "md5(CAST(o_orderkey AS string)) AS head_sha",
        "CASE WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE 'completed' END AS status",
        "CASE o_orderkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'timed_out' WHEN 3 THEN 'cancelled' END AS conclusion",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS timestamp) AS run_started_at",
        "CAST(o_orderdate AS timestamp) AS created_at", "CAST(o_orderdate AS timestamp) AS updated_at", "lower(o_orderpriority) AS head_branch")


add("dl5_runs_to_deployments", lambda spark, sf: dl.runs_to_deployments(
    workflow_runs(spark, sf), F.lit("1995-06-17").cast("timestamp")), """
SELECT 's' || (o_custkey % 20) AS service_id, o_orderkey::VARCHAR AS source_run_id, left(md5(o_orderkey::VARCHAR), 7) AS version,
       lower(o_orderpriority) AS environment, md5(o_orderkey::VARCHAR) AS commit_sha,
       CASE WHEN o_orderstatus = 'O' THEN 'IN_PROGRESS' WHEN o_orderkey % 5 IN (1, 2) THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 HOUR ELSE o_orderdate END AS deployed_at,
       CASE o_orderkey % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'timed_out' WHEN 3 THEN 'cancelled' END AS conclusion
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-17'""")

METRIC_BODY = (
    "CASE event_id % 4 "
    "WHEN 0 THEN '{\"status\":\"success\",\"data\":{\"resultType\":\"matrix\",\"result\":[{\"metric\":{\"service\":\"' || service_id || "
    "'\"},\"values\":[[' || (1000 + event_id) || ',\"' || value || '\"],[' || (1010 + event_id) || '.5,\"3\"]]},"
    "{\"metric\":{\"service\":\"z\"},\"values\":[[7,\"1\"]]}]}}' "
    "WHEN 1 THEN '{\"status\":\"success\",\"data\":{\"resultType\":\"vector\",\"result\":[{\"metric\":{},\"value\":[' || (1500 + event_id) || "
    "',\"0.42\"]},{\"metric\":{},\"value\":[1,\"9\"]}]}}' "
    "WHEN 2 THEN '{\"status\":\"success\",\"data\":{\"resultType\":\"vector\",\"result\":[]}}' "
    "ELSE '{\"status\":\"error\",\"error\":\"bad ' || event_id || '\"}' END")


def metric_responses(spark, sf):
    return b.events(spark, sf).select("event_id", F.expr(METRIC_BODY).alias("body"))


add("dl6_metric_points", lambda spark, sf: dl.flatten_metrics(metric_responses(spark, sf)).select(
    "event_id", "series", F.col("labels")["service"].alias("service"), "ts", "value"), """
SELECT event_id, 0 AS series, service_id AS service, make_timestamp((1000 + event_id) * 1000000) AS ts, value FROM ev WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 0, service_id, make_timestamp((1010 + event_id) * 1000000 + 500000), 3.0 FROM ev WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, 'z', make_timestamp(7000000), 1.0 FROM ev WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 0, NULL, make_timestamp((1500 + event_id) * 1000000), 0.42 FROM ev WHERE event_id % 4 = 1""")
add("dl6_metric_errors", lambda spark, sf: dl.metric_errors(metric_responses(spark, sf)).select("event_id", "error"),
    "SELECT event_id, 'bad ' || event_id AS error FROM ev WHERE event_id % 4 = 3")

# --- CI, diffs, details -------------------------------------------------------------------


def _ci(spark, sf):
    orders = b.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("repository_id"), F.col("o_orderkey").cast("string").alias("sha"),
        "o_orderkey")
    lines = b.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    runs = lines.filter("l_linenumber <= 3 AND o_orderkey % 6 <> 0").selectExpr(
        "repository_id", "sha", "CASE WHEN l_linestatus = 'O' THEN 'queued' ELSE 'completed' END AS status",
        "CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'failure' WHEN l_returnflag = 'A' THEN 'success' END AS conclusion")
    states = lines.filter("l_linenumber > 3 AND o_orderkey % 6 <> 0").selectExpr(
        "repository_id", "sha", "CASE WHEN l_quantity > 48 THEN 'error' WHEN l_quantity > 30 THEN 'pending' ELSE 'success' END AS state")
    return dl.ci_rollup(orders, runs, states)


add("dl10_ci_rollup", _ci, """
WITH reports AS (
  SELECT l_orderkey, CASE WHEN l_linenumber <= 3 THEN l_returnflag = 'R' AND l_quantity > 40 ELSE l_quantity > 48 END AS failed,
         CASE WHEN l_linenumber <= 3 THEN l_linestatus = 'O' ELSE l_quantity > 30 AND l_quantity <= 48 END AS pending
  FROM lineitem WHERE l_orderkey % 6 <> 0),
flags AS (SELECT l_orderkey, bool_or(failed) AS failed, bool_or(pending) AS pending, count(*) AS n FROM reports GROUP BY 1)
SELECT 'r' || (o_custkey % 7) AS repository_id, o_orderkey::VARCHAR AS sha, coalesce(n, 0) AS reports,
       CASE WHEN failed THEN 'failing' WHEN pending OR n IS NULL THEN 'pending_or_unknown' ELSE 'passing' END AS overall
FROM orders LEFT JOIN flags ON l_orderkey = o_orderkey""")
add("dl11_pr_diff", lambda spark, sf: dl.pr_diff(b.table(spark, sf, "documents").select(
    F.col("source").alias("repository_id"), F.col("lang").alias("number"), F.col("doc_id").cast("string").alias("filename"),
    F.col("doc_id").alias("position"), F.col("text").alias("patch"))).select(
    "repository_id", "number", "filename", "patch", "total_files", "truncated"), """
SELECT source AS repository_id, lang AS number, doc_id::VARCHAR AS filename, left(text, 2000) AS patch,
       count(*) OVER (PARTITION BY source, lang) AS total_files, count(*) OVER (PARTITION BY source, lang) > 50 AS truncated
FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 50""")

PR_BODY = (
    "'{\"number\":' || o_orderkey || ',\"title\":\"T' || o_custkey || '\",\"state\":\"open\",\"draft\":' || "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',\"user\":' || "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{\"login\":\"u' || o_custkey || '\"}' END || "
    "',\"base\":{\"ref\":\"main\",\"sha\":\"b\"},\"head\":{\"ref\":\"f' || o_orderkey || '\",\"sha\":\"h\"},\"additions\":5}'")
ISSUE_BODY = (
    "'{\"number\":' || o_orderkey || ',\"title\":\"I\",\"labels\":[\"' || o_orderstatus || '\",{\"name\":\"' || "
    "o_orderpriority || '\"}],\"comments\":' || (o_orderkey % 30) || '}'")
ISSUE_COMMENTS = (
    "'[' || concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN '{\"user\":{\"login\":\"a\"},\"body\":\"x' || o_custkey || '\"}' END, "
    "CASE WHEN o_orderkey % 3 = 0 THEN '{\"body\":\"y\"}' END) || ']'")
add("dl13_pr_details", lambda spark, sf: dl.pr_details(b.table(spark, sf, "orders").select(
    F.lit("r").alias("repository_id"), F.expr(PR_BODY).alias("body"))).select(
    "number", "title", "is_draft", "author", "base_ref", "head_ref", "additions"), """
SELECT o_orderkey::INTEGER AS number, 'T' || o_custkey AS title, o_orderkey % 2 = 0 AS is_draft,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || o_custkey END AS author, 'main' AS base_ref, 'f' || o_orderkey AS head_ref,
       5 AS additions FROM orders""")
add("dl13_issue_details", lambda spark, sf: dl.issue_details(b.table(spark, sf, "orders").select(
    F.lit("r").alias("repository_id"), F.expr(ISSUE_BODY).alias("body"), F.expr(ISSUE_COMMENTS).alias("comments"))).select(
    "number", F.array_join("labels", ",").alias("labels"), "comment_count",
    F.array_join(F.transform("recent_comments", lambda c: F.concat(F.coalesce(c["author"], F.lit("-")), F.lit(":"), c["body"])), ";").alias("comments")), """
SELECT o_orderkey::INTEGER AS number, o_orderstatus || ',' || o_orderpriority AS labels, (o_orderkey % 30)::INTEGER AS comment_count,
       concat_ws(';', CASE WHEN o_orderkey % 2 = 0 THEN 'a:x' || o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN '-:y' END) AS comments
FROM orders""")

# --- lists ----------------------------------------------------------------------------------


def order_rows(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), "o_custkey").alias("repository_id"), F.col("o_orderkey").cast("string").alias("sha"),
        F.col("o_orderkey").alias("number"), F.concat(F.lit("b"), "o_orderkey").alias("name"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


add("dl7_recent_commits", lambda spark, sf: dl.recent_commits(order_rows(spark, sf), 5).select(
    "repository_id", "sha", "position"), """
SELECT 'r' || o_custkey AS repository_id, o_orderkey::VARCHAR AS sha,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR)::INTEGER AS position
FROM orders QUALIFY position <= 5""")
add("dl7_branches_by_name", lambda spark, sf: dl.list_branches(order_rows(spark, sf)).select("repository_id", "name"),
    "SELECT 'r' || o_custkey AS repository_id, 'b' || o_orderkey AS name FROM orders")
add("dl7_contributors", lambda spark, sf: dl.list_contributors(b.table(spark, sf, "orders").groupBy(
    F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("repository_id"), F.concat(F.lit("u"), "o_custkey").alias("login")).agg(
    F.count("*").alias("contributions"))), """
SELECT 'r' || (o_custkey % 7) AS repository_id, 'u' || o_custkey AS login, count(*) AS contributions FROM orders GROUP BY 1, 2""")
add("dl7_newest_pull_requests", lambda spark, sf: dl.list_by_creation(order_rows(spark, sf)).select(
    "repository_id", "number", "created_at"),
    "SELECT 'r' || o_custkey AS repository_id, o_orderkey AS number, o_orderdate AS created_at FROM orders")


def repositories(spark, sf):
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("primary_language"),
        F.col("p_size").alias("stars_count"), F.col("p_retailprice").alias("pushed_at"), F.col("p_partkey").alias("created_at"))


for _sort in ("name", "stars", "updated", "created"):
    add(f"dl8_repositories_by_{_sort}", lambda spark, sf, sort=_sort: dl.list_repositories(
        repositories(spark, sf), "RING", "ECONOMY", sort).select("id", "name"),
        "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%ring%' AND p_type = 'ECONOMY'")


def offered(spark, sf):
    available = b.table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("github_repo_id"), F.col("c_name").alias("name"))
    imported = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("github_repo_id"))
    return available, imported


b.CTES["imported"] = "SELECT DISTINCT o_custkey FROM orders"
add("dl9_importable", lambda spark, sf: dl.importable(*offered(spark, sf)), """
SELECT c_custkey * 3 AS github_repo_id, c_name AS name, c_custkey * 3 IN (SELECT o_custkey FROM imported) AS already_imported FROM customer""")
add("dl9_new_repositories", lambda spark, sf: dl.new_repositories(*offered(spark, sf)), """
SELECT c_custkey * 3 AS github_repo_id, c_name AS name FROM customer WHERE c_custkey * 3 NOT IN (SELECT o_custkey FROM imported)""")
add("dl12_list_deployments", lambda spark, sf: dl.list_deployments(
    b.deployments(spark, sf), environment="main", status="SUCCESS", page=2, page_size=25).select(
    "id", "service_id", "deployed_at", "total_count"), """
SELECT id, service_id, deployed_at, count(*) OVER () AS total_count FROM deployments_ev
WHERE environment = 'main' AND status = 'SUCCESS' ORDER BY deployed_at DESC, id LIMIT 25 OFFSET 25""")
