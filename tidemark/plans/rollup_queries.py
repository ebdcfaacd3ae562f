"""Dashboard rollups and reports over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths, scores as sc
from tidemark.operators import enrichment as en, findings as fp, rollups as ro
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, quoted


def order_commits(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey") % 40).alias("repository_id"), F.col("o_orderdate").cast("timestamp").alias("committed_at"))


add("ro1_commit_activity", lambda spark, sf: ro.commit_activity(order_commits(spark, sf)), """
SELECT repository_id, day, commits FROM (
  SELECT 'r' || (o_custkey % 40) AS repository_id, o_orderdate::DATE AS day, count(*) AS commits FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY day DESC) <= 14""")
add("ro2_top_contributors", lambda spark, sf: ro.top_contributors(b.table(spark, sf, "orders").groupBy(
    F.concat(F.lit("r"), F.col("o_custkey") % 40).alias("repository_id"), F.concat(F.lit("u"), "o_custkey").alias("login")).agg(
    F.count("*").alias("contributions"))), """
SELECT repository_id, login, contributions, row_number() OVER (PARTITION BY repository_id ORDER BY contributions DESC, login)::INTEGER AS position
FROM (SELECT 'r' || (o_custkey % 40) AS repository_id, 'u' || o_custkey AS login, count(*) AS contributions FROM orders GROUP BY 1, 2) QUALIFY position <= 8""")
add("ro3_languages", lambda spark, sf: ro.languages(b.table(spark, sf, "documents"), "lang"), "SELECT DISTINCT lang AS language FROM documents")
add("ro4_weakest_scores", lambda spark, sf: ro.weakest_scores(fp.latest_analysis(b.analyses(spark, sf))).select(
    "repository_id", "score_name", "score", "position"), f"""
SELECT repository_id, score_name, score, row_number() OVER (PARTITION BY analysis_id ORDER BY score, list_position([{", ".join(f"'{k}'" for k in fp.SCORE_CATEGORY)}], score_name))::INTEGER AS position
FROM latest_scores WHERE score_name <> 'overall' AND score IS NOT NULL QUALIFY position <= 3""")
add("ro5_health_headline", lambda spark, sf: ro.health_headline(b.analyses(spark, sf), b.findings(spark, sf)), """
SELECT analysis_id, repository_id, CASE WHEN c > 0 THEN 'danger' WHEN h > 0 OR overall_score < 60 THEN 'warning' ELSE 'success' END AS tone,
  CASE WHEN c > 0 THEN c || ' critical issue' || CASE WHEN c = 1 THEN '' ELSE 's' END || ' need attention'
       WHEN h > 0 THEN h || ' high-severity issue' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' to review'
       WHEN overall_score < 60 THEN 'Overall score is below a healthy threshold' ELSE 'No critical issues found' END AS headline
FROM (SELECT a.id AS analysis_id, a.repository_id, a.overall_score, count(*) FILTER (f.severity = 'CRITICAL') AS c, count(*) FILTER (f.severity = 'HIGH') AS h
      FROM ana a LEFT JOIN fnd f ON f.analysis_id = a.id GROUP BY 1, 2, 3)""")
add("ro6_score_bands", lambda spark, sf: b.table(spark, sf, "customer").select(
    "c_custkey", sc.score_band(F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100).cast("int"))).alias("band")), """
SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'none' WHEN floor(c_acctbal / 100) >= 80 THEN 'good' WHEN floor(c_acctbal / 100) >= 60 THEN 'fair' ELSE 'poor' END AS band FROM customer""")
add("ro7_incident_tiles", lambda spark, sf: ro.incident_tiles(b.incidents(spark, sf), b.services(spark, sf)), """
SELECT 'o1' AS organization_id, count(*) FILTER (status IN ('DETECTED', 'INVESTIGATING')) AS active_incidents,
       count(*) FILTER (status IN ('DETECTED', 'INVESTIGATING') AND severity = 'CRITICAL') AS critical_incidents, (SELECT count(*) FROM svc_reg) AS services FROM incidents_ev""")


def order_tasks(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_custkey") % 6).alias("organization_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'QUEUED' ELSE 'FAILED' END END").alias("status"))


add("ro8_task_counts", lambda spark, sf: ro.task_counts(order_tasks(spark, sf)), """
WITH t AS (SELECT 'o' || (o_custkey % 6) AS organization_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'QUEUED' ELSE 'FAILED' END END AS s FROM orders)
SELECT o.organization_id, v.status, (SELECT count(*) FROM t WHERE t.organization_id = o.organization_id AND (t.s = v.status OR v.status = 'TOTAL'
  OR (v.status = 'ACTIVE' AND t.s IN ('QUEUED', 'RUNNING', 'PENDING_APPROVAL')))) AS tasks
FROM (SELECT DISTINCT organization_id FROM t) o, (VALUES ('QUEUED'), ('RUNNING'), ('PENDING_APPROVAL'), ('COMPLETED'), ('FAILED'), ('CANCELLED'), ('ACTIVE'), ('TOTAL')) v(status)""")


def event_tasks(spark, sf):
    return b.events(spark, sf).select(
        F.col("event_id").alias("id"), "repository_id", F.upper("event_type").alias("status"), F.lit("pr-review").alias("workflow_key"),
        F.replace("props", F.lit('"k"'), F.lit('"prNumber"')).alias("workflow_params"), F.col("ts").alias("created_at"))


add("ro9_list_tasks", lambda spark, sf: ro.list_tasks(event_tasks(spark, sf), status="VIEW", workflow_key="pr-review", pr_number=29, page_size=10).select(
    "id", "created_at", "total_count", "total_pages"), """
SELECT event_id AS id, ts AS created_at, count(*) OVER () AS total_count, greatest(1, ceil(count(*) OVER () / 10))::BIGINT AS total_pages FROM events
WHERE event_type = 'view' AND (props->>'$.k') = '29' ORDER BY ts DESC, event_id LIMIT 10""")


def _trace(spark, sf):
    turns = b.table(spark, sf, "conversations").withColumn("execution_id", F.concat_ws("-", "conv_id", "turn"))
    executions = turns.select("execution_id", F.col("conv_id").alias("task_id"), F.col("turn").alias("step_index"), F.col("role").alias("agent_key"))
    logs = turns.select("execution_id", F.posexplode(F.split("text", "\n")).alias("created_at", "message"))
    validations = turns.filter("turn % 2 = 1").select("execution_id", F.lit(0).alias("position"), (F.col("conv_id") % 2 == 0).alias("passed"))
    calls = turns.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("turn") % 3 + 1))).select(
        "execution_id", "position", F.concat(F.lit("t"), "position").alias("tool_name"), F.lit("SUCCESS").alias("status"))
    return ro.execution_trace(executions, logs, validations, calls)


add("ro10_execution_trace", lambda spark, sf: _trace(spark, sf).select(
    "task_id", "step_index", F.size("logs").alias("logs"), F.md5(F.array_join(F.transform("logs", lambda x: x["message"]), "|")).alias("log_md5"),
    F.col("validations")[0]["passed"].alias("passed"), F.array_join(F.transform("tool_invocations", lambda x: x["tool_name"]), ",").alias("tools")), """
SELECT conv_id AS task_id, turn AS step_index, len(string_split(text, chr(10)))::INTEGER AS logs, md5(replace(text, chr(10), '|')) AS log_md5,
       CASE WHEN turn % 2 = 1 THEN conv_id % 2 = 0 END AS passed, array_to_string(list_transform(range(1, turn % 3 + 2), lambda i: 't' || i), ',') AS tools
FROM conversations""")


def _progress(spark, sf):
    tasks = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("step_count"))
    executions = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("string").alias("agent_key"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'COMPLETED' WHEN 'A' THEN 'SKIPPED' ELSE 'PENDING' END").alias("status"))
    return ro.task_progress(tasks, executions)


add("ro11_task_progress", _progress, """
SELECT o_orderkey AS task_id, coalesce(n, 0) AS done, o_orderkey % 8 AS step_count,
       floor(CASE WHEN o_orderkey % 8 > 0 THEN coalesce(n, 0) / (o_orderkey % 8) * 100 END + 0.5)::BIGINT AS progress
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1) ON l_orderkey = o_orderkey""")
add("ro12_tool_stats", lambda spark, sf: ro.tool_stats(b.events(spark, sf).select(
    F.col("event_type").alias("tool_name"), F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
    F.when(F.col("event_id") % 9 == 0, "FAILED").otherwise("SUCCESS").alias("status"))).withColumn("failure_share", F.round("failure_share", 6)), """
SELECT event_type AS tool_name, count(*) AS calls, round(count(*) FILTER (event_id % 9 = 0) / count(*), 6) AS failure_share,
       quantile_cont(floor(value * 10), 0.5) AS p50_ms, quantile_cont(floor(value * 10), 0.95) AS p95_ms FROM events GROUP BY 1""")
add("ro13_paging", lambda spark, sf: fp.paged(b.table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey").asc()], 4, 30), """
SELECT o_orderkey, count(*) OVER () AS total_count, greatest(1, ceil(count(*) OVER () / 30))::BIGINT AS total_pages FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 90""")
add("ro14_short_label", lambda spark, sf: b.table(spark, sf, "pages").select(
    "page_id", paths.short_label(F.regexp_replace("url", "^https?://", "")).alias("label")), """
SELECT page_id, CASE WHEN len(p) > 2 THEN '.../' || p[len(p) - 1] || '/' || p[len(p)] ELSE u END AS label FROM (
  SELECT page_id, u, string_split(u, '/') AS p FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages))""")

# --- reports ----------------------------------------------------------------------------------------


def report_inputs(spark, sf):
    analyses = b.analyses(spark, sf).withColumn(
        "architecture_summary", F.when(F.col("overall_score") % 2 == 0, F.concat(F.lit("Summary "), "id")))
    repositories = b.events(spark, sf).select(F.col("repository_id").alias("id")).distinct().withColumn("full_name", F.concat(F.lit("org/"), "id"))
    return fp.latest_analysis(analyses), repositories, en.with_impact(b.findings(spark, sf))


_scores = ", ".join(f"'\"{k}\":' || coalesce({k}_score::VARCHAR, 'null')" for k in ro.SCORE_LABELS.values()).replace(", '\"", " || ',' || '\"")
add("rep1_json_report", lambda spark, sf: ro.json_report(*report_inputs(spark, sf)), f"""
SELECT a.id AS analysis_id, '{{"repository":{{"id":"' || repository_id || '","name":"org/' || repository_id || '"}},"analysis_id":"' || a.id || '","scores":{{' || {_scores}
  || '}},"architecture_summary":' || CASE WHEN overall_score % 2 = 0 THEN '"Summary ' || a.id || '"' ELSE 'null' END || ',"findings":[' || coalesce((
  SELECT string_agg('{{"id":"' || id || '","category":"' || category || '","type":"' || type || '","severity":"' || severity || '","confidence":' || confidence || ',"title":"'
    || title || '","file_path":' || coalesce('"' || file_path || '"', 'null') || '}}', ',' ORDER BY rank DESC, created_at, id)
  FROM fnd f JOIN ranked_severity USING (severity) WHERE f.analysis_id = a.id), '') || ']}}' AS report FROM latest_ana a""")
_nl = " || chr(10) || "
_rows = _nl.join(f"'| {label} | ' || coalesce({key}_score::VARCHAR, 'N/A') || ' |'" for label, key in ro.SCORE_LABELS.items())
_impact = "CASE type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in en.IMPACT_BY_TYPE.items()) + f" ELSE {quoted(en.DEFAULT_IMPACT)} END"
add("rep2_markdown_report", lambda spark, sf: ro.markdown_report(*report_inputs(spark, sf)), f"""
SELECT a.id AS analysis_id, '# Engineering Analysis Report: org/' || repository_id || chr(10) || chr(10) || 'Analysis completed: '
  || strftime(date_trunc('millisecond', completed_at), '%Y-%m-%dT%H:%M:%S.%gZ') || chr(10) || chr(10) || '## Scores' || chr(10) || chr(10) || '| Metric | Score |' || chr(10) || '| --- | --- |' || chr(10)
  || {_rows} || chr(10) || chr(10) || '## Architecture Summary' || chr(10) || chr(10) || CASE WHEN overall_score % 2 = 0 THEN 'Summary ' || a.id ELSE 'Not available.' END
  || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || coalesce((SELECT string_agg(concat_ws(chr(10), '### [' || severity || '] ' || title, '', '- **Category**: ' || category || ' / ' || type,
      '- **Priority**: ' || severity, '- **Confidence**: ' || confidence || '%', '- **Location**: ' || file_path || coalesce(':' || start_line, ''), '- **Explanation**: why',
      '- **Evidence**: ' || evidence, '- **Suggested Fix**: ' || suggested_fix, '- **Estimated Impact**: ' || {_impact},
      CASE WHEN len(related_files) > 0 THEN '- **Related Files**: ' || array_to_string(related_files, ', ') END, ''), chr(10) ORDER BY rank DESC, created_at, id)
    FROM fnd f JOIN ranked_severity USING (severity) WHERE f.analysis_id = a.id), 'No findings.') AS report FROM latest_ana a""")
