"""Scores, enrichment and finding lists over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import enrichment as en, findings as fp, rules, scores
from tidemark.plans import bindings as b
from tidemark.session import cut_lineage
from tidemark.plans.registry import add, quoted
from tidemark.plans.rule_queries import line_oracle

# --- flagship: worst sources and the findings behind them ----------------------------


def worst_sources(spark, sf):
    rows = rules.scan_rules(b.code_files(spark, sf)).unionByName(rules.unsafe_cors(b.code_files(spark, sf)))
    rows = en.with_priority(rows.withColumn("id", F.concat_ws(":", "file_path", "start_line", "type", "title")))
    rows = cut_lineage(rows)  # score and top read the findings, not the files
    scored = scores.category_scores(rows).select("repository_id", "security_score")
    top = fp.top_findings(rows.withColumn("created_at", F.lit(None).cast("timestamp")), 3, ["repository_id"])
    return top.join(scored, "repository_id").select(
        "repository_id", "security_score", "position", "severity", "priority", "title", "file_path", "start_line")


b.CTES["line_hits"] = " UNION ALL ".join(line_oracle("code_lines", "code_files", rule) for rule in rules.LINE_RULES) + f"""
UNION ALL SELECT repository_id, 'UNSAFE_CONFIGURATION', 'HIGH', 65, 'CORS allows any origin together with credentials in ' || path, NULL, path, NULL
FROM code_files WHERE regexp_matches(content, {quoted(rules.CORS_WILDCARD)}) AND regexp_matches(content, {quoted(rules.CORS_CREDENTIALS)})"""
add("flagship_worst_sources", worst_sources, """
WITH hits AS (SELECT h.*, rank, penalty, concat_ws(':', file_path, start_line, type, title) AS id FROM line_hits h JOIN ranked_severity USING (severity)),
scored AS (SELECT repository_id, greatest(0, 100 - sum(penalty))::INTEGER AS security_score FROM hits GROUP BY 1)
SELECT repository_id, security_score, row_number() OVER (PARTITION BY repository_id ORDER BY rank DESC, id)::INTEGER AS position, severity,
       (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + least(4, rank + 1 - CASE WHEN confidence < 50 THEN 1 ELSE 0 END)] AS priority,
       title, file_path, start_line
FROM hits JOIN scored USING (repository_id) QUALIFY position <= 3""")

# --- scores ---------------------------------------------------------------------------

add("sc1_category_scores", lambda spark, sf: scores.category_scores(b.findings(spark, sf), ["repository_id", "analysis_id"]), """
SELECT repository_id, analysis_id,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'DEPENDENCY'), 0))::INTEGER AS architecture_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'SECURITY'), 0))::INTEGER AS security_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'PERFORMANCE'), 0))::INTEGER AS performance_score
FROM fnd JOIN ranked_severity USING (severity) GROUP BY 1, 2""")
add("sc2_type_scores", lambda spark, sf: scores.type_scores(b.findings(spark, sf)), """
SELECT repository_id,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (type IN ('BLOCKING_OPERATION', 'N_PLUS_ONE_QUERY',
    'HEAVY_DATABASE_CALL', 'MISSING_CACHING')), 0))::INTEGER AS scalability_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (type = 'LAYER_VIOLATION'), 0))::INTEGER AS layering_score
FROM fnd JOIN ranked_severity USING (severity) GROUP BY 1""")


def finding_files(spark, sf):
    """Each user's finding files, as that repository's file table."""
    return b.findings(spark, sf).filter("file_path IS NOT NULL").select(
        "repository_id", F.col("file_path").alias("path")).distinct()


b.CTES["finding_files"] = "SELECT DISTINCT repository_id, file_path AS path FROM fnd WHERE file_path IS NOT NULL"
add("sc7_technical_debt", lambda spark, sf: scores.debt(b.findings(spark, sf), finding_files(spark, sf)), """
SELECT f.repository_id, greatest(0, least(100, round_even(100 - p.penalty / f.n * 10, 0)))::INTEGER AS technical_debt_score
FROM (SELECT repository_id, count(*) AS n FROM finding_files GROUP BY 1) f
JOIN (SELECT repository_id, sum(penalty) AS penalty FROM fnd JOIN ranked_severity USING (severity) GROUP BY 1) p
  USING (repository_id)""")

# --- enrichment -----------------------------------------------------------------------

add("en1_priority", lambda spark, sf: en.with_priority(b.findings(spark, sf)).select("id", "priority"), """
SELECT id, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + greatest(0, least(4, rank
  + CASE WHEN category = 'SECURITY' THEN 1 ELSE 0 END - CASE WHEN confidence < 50 THEN 1 ELSE 0 END))] AS priority
FROM fnd JOIN ranked_severity USING (severity)""")
add("en2_evidence", lambda spark, sf: en.with_evidence(b.findings(spark, sf)).select("id", "evidence"), """
SELECT id, coalesce(nullif(evidence, ''), 'Cyclomatic complexity: ' || (metadata->>'$.complexity'),
  array_to_string(from_json(metadata->'$.cycle', '["VARCHAR"]'), ' -> '), 'Nesting depth: ' || (metadata->>'$.depth'),
  (metadata->>'$.loop_depth') || ' nested loops',
  (metadata->>'$.method_count') || ' methods, ' || coalesce(metadata->>'$.lines', '?') || ' lines',
  (metadata->>'$.element_count') || ' inline elements',
  array_to_string(from_json(metadata->'$.vuln_ids', '["VARCHAR"]'), ', '), title) AS evidence
FROM fnd""")
add("en3_related_files", lambda spark, sf: en.with_related_files(b.findings(spark, sf)).select(
    "id", F.array_join("related_files", ",").alias("related_files")), """
SELECT id, CASE WHEN (metadata->'$.cycle') IS NOT NULL THEN 'a,b' || (id::BIGINT % 6)
  WHEN (metadata->'$.locations') IS NOT NULL THEN 'l1,l2'
  WHEN (metadata->>'$.target_path') IS NOT NULL AND file_path IS NOT NULL THEN file_path || ',' || (metadata->>'$.target_path')
  ELSE coalesce(file_path, '') END AS related_files
FROM fnd""")
_function_types = ", ".join(quoted(t) for t in en.FUNCTION_TYPES)
_class_types = ", ".join(quoted(t) for t in en.CLASS_TYPES)
add("en4_related_symbols", lambda spark, sf: en.with_related_symbols(b.findings(spark, sf)).select(
    "id", F.array_join("related_classes", ",").alias("classes"), F.array_join("related_functions", ",").alias("functions")), f"""
SELECT id, array_to_string(list_filter([CASE WHEN type IN ({_class_types}) THEN symbol_name END,
         CASE WHEN (metadata->'$.instantiated_types') IS NOT NULL THEN 'T1' END], lambda x: x IS NOT NULL), ',') AS classes,
       array_to_string(list_filter([CASE WHEN type IN ({_function_types}) THEN symbol_name END,
         CASE WHEN (metadata->'$.method_names') IS NOT NULL THEN 'm1,m2' END], lambda x: x IS NOT NULL), ',') AS functions
FROM fnd""")
add("en5_estimated_impact", lambda spark, sf: en.with_impact(b.findings(spark, sf)).select("id", "estimated_impact"),
    "SELECT id, CASE type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in en.IMPACT_BY_TYPE.items())
    + f" ELSE {quoted(en.DEFAULT_IMPACT)} END AS estimated_impact FROM fnd")

# --- the finding pipeline -------------------------------------------------------------


def three_rules(spark, sf):
    files = b.code_files(spark, sf)
    merged, _ = fp.run_rules({
        "tls": lambda: rules.scan_rules(files, [rules.WEAK_TLS]),
        "debug": lambda: rules.scan_rules(files, [rules.DEBUG_ON]),
        "cors": lambda: rules.unsafe_cors(files),
    })
    return merged.groupBy("repository_id", "type").agg(F.count("*").alias("n"))


add("fp1_run_rules", three_rules, f"""
SELECT repository_id, type, count(*) AS n FROM (
  SELECT repository_id, 'WEAK_AUTHENTICATION' AS type FROM code_lines WHERE regexp_matches(line, 'verify\\s*=\\s*False')
  UNION ALL SELECT repository_id, 'UNSAFE_CONFIGURATION' FROM code_lines
    WHERE regexp_matches(line, '^\\s*DEBUG\\s*=\\s*True\\s*$') OR regexp_matches(line, '(?i)debug\\s*:\\s*true')
  UNION ALL SELECT repository_id, 'UNSAFE_CONFIGURATION' FROM code_files
    WHERE regexp_matches(content, {quoted(rules.CORS_WILDCARD)}) AND regexp_matches(content, {quoted(rules.CORS_CREDENTIALS)}))
GROUP BY ALL""")


def verdicts(spark, sf):
    return b.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("confirmed"),
        F.when(F.col("toxic") == 0, (F.col("doc_id") % 101).cast("int")).alias("confidence"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("judged "), "doc_id")).alias("explanation"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("do this")).alias("suggested_fix"))


add("fp2_apply_verdicts", lambda spark, sf: fp.apply_verdicts(
    b.findings(spark, sf), verdicts(spark, sf), ["QUALITY", "SECURITY"]).select(
    "id", "category", "confidence", "explanation", "suggested_fix"), """
SELECT id, category, confidence, explanation, suggested_fix FROM fnd WHERE category NOT IN ('QUALITY', 'SECURITY')
UNION ALL
SELECT f.id, category, CASE WHEN l.toxic = 0 THEN (l.doc_id % 101)::INTEGER ELSE confidence END,
       CASE WHEN l.doc_id % 3 = 0 THEN explanation ELSE 'judged ' || l.doc_id END,
       CASE WHEN l.doc_id % 4 = 0 THEN 'do this' END
FROM fnd f JOIN labels l ON l.doc_id::VARCHAR = f.id
WHERE category IN ('QUALITY', 'SECURITY') AND l.quality = 1""")


def document_findings(spark, sf):
    """Two findings per document: one with a line range, one without."""
    docs = b.table(spark, sf, "documents").select(
        F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_path"), "doc_id",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    return docs.select(
        F.concat("file_path", F.lit("-"), "n").alias("id"), "repository_id", "file_path",
        F.when(F.col("n") == 0, (F.col("doc_id") % 5 + 1).cast("int")).alias("start_line"),
        F.when(F.col("n") == 0, (F.col("doc_id") % 5 + 3).cast("int")).alias("end_line"))


b.CTES["doc_findings"] = """
SELECT doc_id || '-' || n AS id, source AS repository_id, doc_id::VARCHAR AS file_path, text,
       CASE WHEN n = 0 THEN doc_id % 5 + 1 END AS start_line, CASE WHEN n = 0 THEN doc_id % 5 + 3 END AS end_line
FROM documents, (VALUES (0), (1)) t(n)"""
add("fp3_snippets", lambda spark, sf: fp.finding_snippets(document_findings(spark, sf), b.document_files(spark, sf)).select(
    "id", "snippet"), """
SELECT id, left(CASE WHEN start_line IS NULL THEN text ELSE
  array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) END, 3000) AS snippet FROM doc_findings""")
add("fp12_finding_context", lambda spark, sf: fp.finding_context(
    document_findings(spark, sf), b.document_files(spark, sf)).select("id", "current_source"), """
SELECT id, CASE WHEN start_line IS NULL THEN text ELSE
  array_to_string(string_split(text, chr(10))[greatest(1, start_line - 2):end_line + 2], chr(10)) END AS current_source
FROM doc_findings""")


def changed_files(spark, sf):
    return finding_files(spark, sf).filter("CAST(substring(path, 2) AS int) % 6 = 0")


add("fp4_scope_to_changes", lambda spark, sf: fp.scope_to_changes(
    b.findings(spark, sf), changed_files(spark, sf)).select("id", "file_path"), """
WITH changed AS (SELECT repository_id, path FROM finding_files WHERE substr(path, 2)::INTEGER % 6 = 0)
SELECT id, file_path FROM fnd f WHERE EXISTS (
  SELECT 1 FROM changed c WHERE c.repository_id = f.repository_id
    AND (c.path = f.file_path OR list_contains(f.related_files, c.path)))""")
for _k, _name in ((fp.HEALTH_REPORT_K, "health_report"), (fp.REVIEW_K, "review"), (fp.EXPLAIN_K, "explanation")):
    add(f"fp5_top_findings_{_name}", lambda spark, sf, k=_k: fp.top_findings(
        b.findings(spark, sf), k, ["repository_id"]).select("repository_id", "id", "severity", "position"), f"""
SELECT repository_id, id, severity, row_number() OVER (PARTITION BY repository_id
  ORDER BY rank DESC, created_at, id)::INTEGER AS position
FROM fnd JOIN ranked_severity USING (severity) QUALIFY position <= {_k}""")
add("fp6_list_findings", lambda spark, sf: fp.list_findings(
    en.with_priority(b.findings(spark, sf)), category="SECURITY", sort_by="priority", page=2, page_size=50).select(
    "id", "priority", "total_count", "total_pages"), """
SELECT id, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + p] AS priority, total_count,
       greatest(1, ceil(total_count / 50))::BIGINT AS total_pages
FROM (SELECT id, greatest(0, least(4, rank + 1 - CASE WHEN confidence < 50 THEN 1 ELSE 0 END)) AS p,
             count(*) OVER () AS total_count
      FROM fnd JOIN ranked_severity USING (severity) WHERE category = 'SECURITY')
ORDER BY p DESC, id LIMIT 50 OFFSET 50""")
add("fp6_list_by_confidence", lambda spark, sf: fp.list_findings(
    b.findings(spark, sf), severity="HIGH", sort_by="confidence", descending=False, page=3).select(
    "id", "confidence", "total_count"), """
SELECT id, confidence, count(*) OVER () AS total_count FROM fnd WHERE severity = 'HIGH'
ORDER BY confidence, id LIMIT 20 OFFSET 40""")
add("fp7_all_findings", lambda spark, sf: fp.all_findings(b.findings(spark, sf), "DEPENDENCY").select(
    "id", "severity", "created_at"), "SELECT id, severity, created_at FROM fnd WHERE category = 'DEPENDENCY'")
add("fp8_latest_completed", lambda spark, sf: fp.latest_analysis(b.analyses(spark, sf)).select(
    "repository_id", "id", "overall_score", "started_at"), """
SELECT repository_id, id, overall_score, started_at FROM ana WHERE status = 'COMPLETED'
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id) = 1""")
add("fp8_latest_any", lambda spark, sf: fp.latest_analysis(b.analyses(spark, sf), False).select(
    "repository_id", "id", "status"), """
SELECT repository_id, id, status FROM ana
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id) = 1""")
add("fp8_history_page", lambda spark, sf: fp.analysis_history(b.analyses(spark, sf), "r1", 2, 5).select(
    "id", "started_at", "total_count", "total_pages"), """
SELECT id, started_at, count(*) OVER () AS total_count, greatest(1, ceil(count(*) OVER () / 5))::BIGINT AS total_pages
FROM ana WHERE status = 'COMPLETED' AND repository_id = 'r1' ORDER BY started_at DESC LIMIT 5 OFFSET 5""")
add("fp9_score_trend", lambda spark, sf: fp.score_trend(b.analyses(spark, sf), 7).select(
    "repository_id", "id", "overall_score", "position", "change"), """
SELECT repository_id, id, overall_score, row_number() OVER w::INTEGER AS position,
       overall_score - lag(overall_score) OVER w AS change
FROM (SELECT * FROM ana WHERE status = 'COMPLETED'
      QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id) <= 7)
WINDOW w AS (PARTITION BY repository_id ORDER BY started_at, id DESC)""")
b.CTES["latest_ana"] = """
SELECT * FROM ana WHERE status = 'COMPLETED'
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id) = 1"""
_score_map = ", ".join(f"('{k}', {quoted(v) if v else 'NULL'})" for k, v in fp.SCORE_CATEGORY.items())
b.CTES["latest_scores"] = f"""
SELECT id AS analysis_id, repository_id, replace(name, '_score', '') AS score_name, score
FROM latest_ana UNPIVOT INCLUDE NULLS (score FOR name IN ({", ".join(f"{k}_score" for k in fp.SCORE_CATEGORY)}))"""
add("fp10_explain_scores", lambda spark, sf: fp.explain_scores(b.analyses(spark, sf), b.findings(spark, sf))[0], f"""
SELECT l.repository_id, l.analysis_id, l.score_name, l.score, m.category,
       (SELECT count(*) FROM fnd f WHERE f.analysis_id = l.analysis_id AND (m.category IS NULL OR f.category = m.category))
         AS contributing_findings
FROM latest_scores l JOIN (VALUES {_score_map}) m(score_name, category) USING (score_name)""")
add("fp10_explaining_findings", lambda spark, sf: fp.explain_scores(b.analyses(spark, sf), b.findings(spark, sf))[1].select(
    "analysis_id", "score_category", "id", "position"), """
SELECT analysis_id, g AS score_category, id, row_number() OVER (PARTITION BY analysis_id, g
  ORDER BY rank DESC, created_at, id)::INTEGER AS position
FROM (SELECT f.*, r.rank, unnest([f.category, '*']) AS g FROM fnd f JOIN ranked_severity r USING (severity)
      WHERE analysis_id IN (SELECT id FROM latest_ana))
QUALIFY position <= 10""")
add("fp11_pattern_instances", lambda spark, sf: fp.pattern_instances(b.findings(spark, sf), "Singleton", "DEPENDENCY").select(
    "id", "title", "confidence"),
    "SELECT id, title, confidence FROM fnd WHERE category = 'DEPENDENCY' AND lower(type) = 'singleton'")
add("fp13_active_conflicts", lambda spark, sf: fp.active_conflicts(b.analyses(spark, sf), "repository_id"), """
SELECT repository_id, count(*) AS active FROM ana WHERE status IN ('PENDING', 'RUNNING') GROUP BY 1 HAVING count(*) > 1""")
