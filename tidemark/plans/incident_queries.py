"""Incidents, their evidence, and webhook routing over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import incidents as inc, webhooks as wh
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, quoted

# --- alerts to incidents -----------------------------------------------------------------

add("in1_dedupe_alerts", lambda spark, sf: inc.dedupe_alerts(b.alerts(spark, sf)).select(
    "fingerprint", "status", "starts_at", "received_at"),
    "SELECT fingerprint, status, starts_at, starts_at AS received_at FROM alerts_once")
SEVERITY_SQL = ("CASE lower(coalesce(severity_label, 'warning')) WHEN 'critical' THEN 'CRITICAL' WHEN 'page' THEN 'CRITICAL' "
                "WHEN 'high' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' WHEN 'info' THEN 'LOW' ELSE 'MEDIUM' END")
add("in2_alert_severity", lambda spark, sf: inc.dedupe_alerts(b.alerts(spark, sf)).select(
    "fingerprint", inc.alert_severity(F.col("labels")).alias("severity")),
    f"SELECT fingerprint, {SEVERITY_SQL} AS severity FROM alerts_once")


def closes(spark, sf):
    return b.events(spark, sf, "signup").select(F.lit("o1").alias("organization_id"), "service_id", F.col("ts").alias("closed_at"))


b.CTES["firing"] = f"""
SELECT s.id AS service_id, a.fingerprint, a.starts_at AS detected_at, {SEVERITY_SQL} AS severity,
       coalesce(nullif(summary, ''), alertname, 'Incident on ' || s.name) AS title
FROM alerts_once a JOIN svc_reg s ON s.name = a.service_label WHERE a.status = 'firing'"""
b.CTES["closes"] = "SELECT service_id, ts AS closed_at FROM ev WHERE event_type = 'signup'"
add("in3_detect_incidents", lambda spark, sf: inc.detect_incidents(
    inc.dedupe_alerts(b.alerts(spark, sf)), b.services(spark, sf), closes(spark, sf)).select(
    "service_id", "fingerprint", "detected_at", "title", "severity"), """
SELECT service_id, fingerprint, detected_at, title, severity FROM (
  SELECT f.*, c.closed_at, row_number() OVER (PARTITION BY f.service_id, c.closed_at ORDER BY detected_at, fingerprint) AS n
  FROM firing f ASOF LEFT JOIN closes c ON c.service_id = f.service_id AND f.detected_at >= c.closed_at)
WHERE n = 1""")


def organizations(spark, sf):
    return b.table(spark, sf, "region").select(F.lit("o1").alias("id"), F.lit("lead").alias("owner_id")).distinct()


add("in4_incident_actor", lambda spark, sf: inc.incident_actor(
    b.incidents(spark, sf), b.services(spark, sf), organizations(spark, sf)).select("id", "actor_id"), """
SELECT i.id, coalesce(s.owner_user_id, 'lead') AS actor_id FROM incidents_ev i LEFT JOIN svc_reg s ON s.id = i.service_id""")

# --- correlation ---------------------------------------------------------------------------


def _service_repository(df):
    """The repository of a service is named after it."""
    return df.withColumn("repository_id", F.concat(F.lit("R"), "service_id"))


def matched(spark, sf):
    return inc.with_deployment(_service_repository(b.incidents(spark, sf)), b.deployments(spark, sf))


def service_commits(spark, sf):
    rows = b.commits(spark, sf).drop("repository_id")
    homes = b.events(spark, sf, "click").select(F.col("event_id"), F.concat(F.lit("R"), "service_id").alias("repository_id"))
    return rows.join(homes, "event_id")


def users(spark, sf):
    ids = b.table(spark, sf, "events").select((F.col("user_id") % 30).alias("n")).distinct().filter("n % 4 <> 3")
    return ids.select(F.concat(F.lit("u"), "n").alias("id"), F.concat(F.lit("User "), "n").alias("name"),
                      F.concat(F.lit("u"), "n", F.lit("@x.org")).alias("email"))


b.CTES["users_ev"] = """
SELECT 'u' || n AS id, 'User ' || n AS name, 'u' || n || '@x.org' AS email
FROM (SELECT DISTINCT user_id % 30 AS n FROM events) WHERE n % 4 <> 3"""
b.CTES["matched"] = """
SELECT i.* EXCLUDE (repository_id), 'R' || i.service_id AS repository_id, d.id AS dep_id, d.version, d.commit_sha, d.environment,
       d.status AS dep_status, d.deployed_at,
       floor((epoch_ms(i.detected_at) - epoch_ms(d.deployed_at)) / 60000.0 + 0.5)::BIGINT AS minutes,
       epoch_ms(i.detected_at) - epoch_ms(d.deployed_at) <= 21600000 AS recent
FROM incidents_ev i ASOF LEFT JOIN deployments_ev d ON d.service_id = i.service_id AND i.detected_at >= d.deployed_at"""
b.CTES["sig_deployment"] = """
SELECT id AS incident_id, 'DEPLOYMENT' AS signal_type, dep_id AS source_ref, CASE WHEN recent THEN 90 ELSE 40 END AS relevance_score,
       CASE WHEN recent THEN 'Recent' ELSE 'Prior' END || ' deployment ' || coalesce(version, left(commit_sha, 7), dep_id) || ' to "'
         || environment || '" ' || minutes || 'm before detection (status: ' || dep_status || ').' AS summary
FROM matched WHERE dep_id IS NOT NULL"""
b.CTES["matched_commits"] = """
SELECT m.*, c.sha, c.message, c.author_name, c.author_email, c.author_login
FROM matched m LEFT JOIN (SELECT c.*, 'R' || e.service_id AS home FROM commits_ev c JOIN ev e USING (event_id)) c
  ON c.home = m.repository_id AND c.sha = m.commit_sha"""
b.CTES["sig_commit"] = """
SELECT id AS incident_id, 'COMMIT' AS signal_type, sha AS source_ref, 85 AS relevance_score,
       'Deployed commit ' || left(sha, 7) || ' by ' || coalesce(author_login, author_name) || ': "' || string_split(message, chr(10))[1]
         || '"' AS summary FROM matched_commits WHERE sha IS NOT NULL"""
b.CTES["sig_pr"] = """
SELECT m.id AS incident_id, 'PULL_REQUEST' AS signal_type, p.id AS source_ref, 60 AS relevance_score,
       'Most recently merged PR before this deployment: #' || number || ' "' || p.title || '" by ' || author_login
         || ' (best-effort match - not a confirmed merge-commit link).' AS summary
FROM (SELECT *, coalesce(deployed_at, detected_at) AS before FROM matched) m
ASOF JOIN prs_ev p ON p.service_id = m.service_id AND m.before >= p.merged_at"""
b.CTES["sig_finding"] = """
SELECT i.id AS incident_id, 'FINDING' AS signal_type, f.id AS source_ref, CASE f.severity WHEN 'CRITICAL' THEN 70 ELSE 55 END AS relevance_score,
       'Existing ' || f.severity || ' ' || lower(category) || ' finding: "' || f.title || '"' || coalesce(' (' || file_path || ')', '') AS summary
FROM (SELECT id, 'R' || service_id AS home FROM incidents_ev) i JOIN (
  SELECT f.*, 'R' || e.service_id AS home FROM fnd f JOIN ev e ON e.event_id::VARCHAR = f.id WHERE severity IN ('HIGH', 'CRITICAL')
  QUALIFY row_number() OVER (PARTITION BY e.service_id ORDER BY created_at DESC, f.id DESC) <= 5) f USING (home)"""
b.CTES["sig_owner"] = """
SELECT m.id AS incident_id, 'OWNERSHIP' AS signal_type, coalesce(o.id, a.id) AS source_ref,
       CASE WHEN o.id IS NOT NULL THEN 50 ELSE 45 END AS relevance_score,
       CASE WHEN o.id IS NOT NULL THEN 'Service owner: ' || o.name || ' (' || o.email || ')'
            ELSE 'Deploying commit''s author (also an organization member): ' || a.name END AS summary
FROM matched_commits m LEFT JOIN svc_reg s ON s.id = m.service_id LEFT JOIN users_ev o ON o.id = s.owner_user_id
LEFT JOIN users_ev a ON a.email = m.author_email WHERE o.id IS NOT NULL OR a.id IS NOT NULL"""
b.CTES["sig_all"] = """
SELECT * FROM sig_deployment UNION ALL SELECT * FROM sig_commit UNION ALL SELECT * FROM sig_pr
UNION ALL SELECT * FROM sig_owner UNION ALL SELECT * FROM sig_finding"""
b.CTES["time_all"] = """
SELECT id AS incident_id, deployed_at AS occurred_at, 'DEPLOYMENT' AS event_type,
       'Deployment ' || coalesce(version, left(commit_sha, 7), dep_id) || ' to "' || environment || '"' AS description,
       dep_id AS source_ref FROM matched WHERE dep_id IS NOT NULL
UNION ALL SELECT id, detected_at, 'INCIDENT_DETECTED', title, NULL FROM incidents_ev"""


def service_findings(spark, sf):
    homes = b.events(spark, sf).select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("R"), "service_id").alias("_home"))
    return b.findings(spark, sf).join(homes, "id").withColumn("repository_id", F.col("_home")).drop("_home")


def correlated(spark, sf):
    return inc.correlate(
        _service_repository(b.incidents(spark, sf)), b.services(spark, sf), b.deployments(spark, sf), service_commits(spark, sf),
        _service_repository(b.pull_requests(spark, sf)), service_findings(spark, sf), users(spark, sf))


add("in5_correlate_deployment", lambda spark, sf: inc.deployment_signals(matched(spark, sf)), "SELECT * FROM sig_deployment")
add("in6_correlate_commit", lambda spark, sf: inc.commit_signals(
    inc.with_commit(matched(spark, sf), service_commits(spark, sf))), "SELECT * FROM sig_commit")


def _one_repository(df):
    return df.withColumn("repository_id", F.lit("R"))


add("in6_correlate_commit_one_repository", lambda spark, sf: inc.commit_signals(
    inc.with_commit(_one_repository(matched(spark, sf)), _one_repository(b.commits(spark, sf)))).select("incident_id", "source_ref"), """
SELECT m.id AS incident_id, c.sha AS source_ref FROM matched m JOIN commits_ev c ON c.sha = m.commit_sha""")
add("in7_correlate_pull_request", lambda spark, sf: inc.pull_request_signals(
    matched(spark, sf), _service_repository(b.pull_requests(spark, sf))), "SELECT * FROM sig_pr")
add("in8_correlate_findings", lambda spark, sf: inc.finding_signals(
    _service_repository(b.incidents(spark, sf)), service_findings(spark, sf)), "SELECT * FROM sig_finding")
add("in8_findings_of_latest_analysis", lambda spark, sf: inc.finding_signals(
    b.incidents(spark, sf), b.findings(spark, sf), True, b.analyses(spark, sf)).select("incident_id", "source_ref", "relevance_score"), """
SELECT i.id AS incident_id, f.id AS source_ref, CASE f.severity WHEN 'CRITICAL' THEN 70 ELSE 55 END AS relevance_score
FROM incidents_ev i JOIN (SELECT * FROM fnd WHERE severity IN ('HIGH', 'CRITICAL') AND analysis_id IN (SELECT id FROM latest_ana)
  QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) <= 5) f USING (repository_id)""")
add("in9_correlate_owner", lambda spark, sf: inc.ownership_signals(
    inc.with_commit(matched(spark, sf), service_commits(spark, sf)), b.services(spark, sf), users(spark, sf)),
    "SELECT * FROM sig_owner")
add("in10_evidence_run", lambda spark, sf: correlated(spark, sf)[0], "SELECT * FROM sig_all")
add("in10_timeline", lambda spark, sf: correlated(spark, sf)[1], "SELECT * FROM time_all")
add("in10_attached_deployment", lambda spark, sf: correlated(spark, sf)[2].select("id", "deployment_id"),
    "SELECT id, coalesce(deployment_id, dep_id) AS deployment_id FROM matched")
add("in11_signals_by_relevance", lambda spark, sf: inc.list_signals(correlated(spark, sf)[0]).select(
    "incident_id", "signal_type", "relevance_score"), "SELECT incident_id, signal_type, relevance_score FROM sig_all")
add("in11_timeline_by_time", lambda spark, sf: inc.list_timeline(correlated(spark, sf)[1]).select(
    "incident_id", "occurred_at", "event_type"), "SELECT incident_id, occurred_at, event_type FROM time_all")
add("in12_default_root_causes", lambda spark, sf: inc.default_root_causes(
    b.incidents(spark, sf), inc.deployment_signals(matched(spark, sf))), f"""
SELECT id AS incident_id, {quoted(inc.NO_EVIDENCE_SUMMARY)} AS summary, {quoted(inc.NO_EVIDENCE_CAUSE)} AS most_likely_cause,
       0 AS confidence_score, service_id AS responsible_service_id, FALSE AS rollback_recommended FROM matched WHERE dep_id IS NULL""")


def supplier_services(spark, sf):
    return b.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("o").alias("organization_id"),
        F.when(F.col("s_nationkey") != 3, F.concat(F.lit("n"), "s_nationkey")).alias("repository_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 5000, "CRITICAL").otherwise("LOW").alias("criticality"))


def order_incidents(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.lit("i"), "l_orderkey").alias("id"), F.lit("o").alias("organization_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("service_id")).distinct()


add("in13_blast_radius", lambda spark, sf: inc.blast_radius(order_incidents(spark, sf), supplier_services(spark, sf)).select(
    "incident_id", "service_id", "repository_id", "affected_services", "critical_services"), """
WITH homes AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_nationkey <> 3 THEN 'n' || s_nationkey END AS home, s_acctbal > 5000 AS critical
               FROM supplier)
SELECT i.id AS incident_id, i.service_id, h.home AS repository_id,
       (SELECT count(*) FROM homes o WHERE o.home = h.home AND o.id <> h.id) AS affected_services,
       (SELECT count(*) FROM homes o WHERE o.home = h.home AND o.id <> h.id AND o.critical) AS critical_services
FROM (SELECT DISTINCT 'i-' || l_orderkey AS id, 's' || l_suppkey AS service_id FROM lineitem) i
LEFT JOIN homes h ON h.id = i.service_id""")
add("in13_affected_services", lambda spark, sf: inc.affected_services(order_incidents(spark, sf), supplier_services(spark, sf)), """
WITH hit AS (SELECT DISTINCT 's' || l_suppkey AS service_id FROM lineitem)
SELECT service_id, 's' || o.s_suppkey AS id, o.s_name AS name, CASE WHEN o.s_acctbal > 5000 THEN 'CRITICAL' ELSE 'LOW' END AS criticality
FROM hit JOIN supplier s ON 's' || s.s_suppkey = service_id JOIN supplier o ON o.s_nationkey = s.s_nationkey
WHERE s.s_nationkey <> 3 AND o.s_suppkey <> s.s_suppkey""")


def health_inputs(spark, sf):
    snapshots = b.events(spark, sf, "view").filter("user_id % 20 <> 5").select(
        "service_id", F.col("ts").alias("captured_at"), F.col("value").alias("error_rate"), (F.col("value") * 10).alias("p95_latency_ms"),
        (F.col("event_id") % 100).cast("int").alias("risk_score"))
    live = b.events(spark, sf, "click").filter("user_id % 20 % 3 = 1").select(
        "service_id", F.col("ts").alias("captured_at"), F.col("value").alias("error_rate"), (F.col("value") * 7).alias("p95_latency_ms"))
    return b.services(spark, sf), snapshots, live


add("in14_service_health", lambda spark, sf: inc.service_health(*health_inputs(spark, sf)), """
WITH snap AS (SELECT service_id, arg_max(value, ts) AS v, max(ts) AS at, arg_max(event_id % 100, ts)::INTEGER AS risk
              FROM ev WHERE event_type = 'view' AND user_id % 20 <> 5 GROUP BY 1),
live AS (SELECT service_id, arg_max(value, ts) AS v, max(ts) AS at FROM ev WHERE event_type = 'click' AND user_id % 20 % 3 = 1 GROUP BY 1)
SELECT s.id AS service_id, CASE WHEN l.at IS NULL THEN 'snapshot' ELSE 'live' END AS source, coalesce(l.at, n.at) AS captured_at,
       coalesce(l.v, n.v) AS error_rate, coalesce(l.v * 7, n.v * 10) AS p95_latency_ms, CASE WHEN l.at IS NULL THEN n.risk END AS risk_score
FROM svc_reg s LEFT JOIN snap n ON n.service_id = s.id LEFT JOIN live l ON l.service_id = s.id""")


def conclusions(spark, sf):
    ev = b.events(spark, sf, "error")
    causes = ev.filter("event_id % 3 <> 1").select(
        F.concat(F.lit("i"), "event_id").alias("incident_id"), F.concat(F.lit("Cause "), "event_id").alias("most_likely_cause"),
        (F.col("event_id") % 101).cast("int").alias("confidence_score"), (F.col("event_id") % 2 == 0).alias("rollback_recommended"))
    advice = ev.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("event_id") % 4))).select(
        F.concat(F.lit("i"), "event_id").alias("incident_id"),
        F.when(F.col("n") % 2 == 0, "ROLLBACK").otherwise("CONFIG_CHANGE").alias("type"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"), F.lit("URGENT")), (F.col("n") + 1).cast("int")).alias("priority"),
        F.concat(F.lit("Do "), "n").alias("title"), F.concat(F.lit("step "), "n").alias("description"))
    return causes, advice


b.CTES["causes"] = """
SELECT 'i' || event_id AS incident_id, 'Cause ' || event_id AS cause, event_id % 101 AS confidence, event_id % 2 = 0 AS rollback
FROM ev WHERE event_type = 'error' AND event_id % 3 <> 1"""
b.CTES["advice"] = """
SELECT 'i' || event_id AS incident_id, n, CASE WHEN n % 2 = 0 THEN 'ROLLBACK' ELSE 'CONFIG_CHANGE' END AS type,
       (['LOW', 'MEDIUM', 'HIGH', 'URGENT'])[n + 1] AS priority, 'Do ' || n AS title, 'step ' || n AS description
FROM (SELECT event_id, unnest(range(0, event_id % 4 + 1)) AS n FROM ev WHERE event_type = 'error')"""
add("in15_rollback_summary", lambda spark, sf: inc.rollback_summary(b.incidents(spark, sf), *conclusions(spark, sf)).withColumn(
    "recommendations", F.array_join("recommendations", ",")), """
SELECT i.id AS incident_id, coalesce(rollback, FALSE) AS rollback_recommended,
       CASE WHEN cause IS NULL THEN 'Root cause analysis has not run yet for this incident.'
            WHEN rollback THEN 'Root cause analysis (confidence ' || confidence || '%) points to: ' || cause
            ELSE 'Root cause analysis did not flag this incident as needing a rollback.' END AS reason,
       CASE WHEN cause IS NOT NULL THEN deployment_id END AS responsible_deployment_id,
       CASE WHEN cause IS NULL THEN '' ELSE coalesce((SELECT string_agg(title, ',' ORDER BY title) FROM advice a
         WHERE a.incident_id = i.id AND type = 'ROLLBACK'), '') END AS recommendations
FROM incidents_ev i LEFT JOIN causes c ON c.incident_id = i.id""")
add("in16_list_incidents", lambda spark, sf: inc.list_incidents(
    b.incidents(spark, sf), status="DETECTED", severity="HIGH", page=2, page_size=10).select("id", "detected_at", "total_count"), """
SELECT id, detected_at, count(*) OVER () AS total_count FROM incidents_ev WHERE status = 'DETECTED' AND severity = 'HIGH'
ORDER BY detected_at DESC, id LIMIT 10 OFFSET 10""")


def dossier(spark, sf):
    signals, timeline, _ = correlated(spark, sf)
    return inc.incident_dossier(b.incidents(spark, sf), signals, timeline, *conclusions(spark, sf))


add("in16_incident_dossier", lambda spark, sf: dossier(spark, sf).select(
    "incident_id", F.col("root_cause.most_likely_cause").alias("cause"),
    F.array_join(F.transform("signals", lambda s: F.concat(s["signal_type"], F.lit(":"), s["source_ref"])), ",").alias("signals"),
    F.array_join(F.transform("timeline", lambda t: t["event_type"]), ",").alias("timeline"),
    F.array_join(F.transform("recommendations", lambda r: r["title"]), ",").alias("recommendations")), """
SELECT i.id AS incident_id, c.cause,
  (SELECT string_agg(signal_type || ':' || source_ref, ',' ORDER BY relevance_score DESC, signal_type, source_ref) FROM sig_all s WHERE s.incident_id = i.id) AS signals,
  (SELECT string_agg(event_type, ',' ORDER BY occurred_at, event_type) FROM time_all t WHERE t.incident_id = i.id) AS timeline,
  (SELECT string_agg(title, ',' ORDER BY n DESC) FROM advice a WHERE a.incident_id = i.id) AS recommendations
FROM incidents_ev i LEFT JOIN causes c ON c.incident_id = i.id""")
add("in17_postmortem_evidence", lambda spark, sf: inc.postmortem_evidence(dossier(spark, sf)), """
SELECT i.id AS incident_id, 'Incident: ' || i.title || ' (severity ' || i.severity || ')' || chr(10) || 'Root cause: ' || c.cause
  || ' (confidence ' || c.confidence || '%)' || chr(10) || 'Rollback recommended: ' || c.rollback || chr(10) || chr(10) || 'Timeline:' || chr(10)
  || (SELECT string_agg('- ' || strftime(date_trunc('millisecond', occurred_at), '%Y-%m-%dT%H:%M:%S.%gZ') || ': ' || description, chr(10) ORDER BY occurred_at, event_type)
      FROM time_all t WHERE t.incident_id = i.id)
  || chr(10) || chr(10) || 'Evidence:' || chr(10)
  || coalesce((SELECT string_agg('- [' || signal_type || '] ' || summary, chr(10) ORDER BY relevance_score DESC, signal_type, source_ref)
      FROM sig_all s WHERE s.incident_id = i.id), '(none)')
  || chr(10) || chr(10) || 'Recommendations:' || chr(10)
  || (SELECT string_agg('- [' || priority || '] ' || title || ': ' || description, chr(10) ORDER BY n DESC) FROM advice a WHERE a.incident_id = i.id)
  AS evidence_text
FROM incidents_ev i JOIN causes c ON c.incident_id = i.id""")
add("in18_services_by_name", lambda spark, sf: inc.list_services(supplier_services(spark, sf), "o").select("id", "name"),
    "SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier")
add("in18_integrations_newest_first", lambda spark, sf: inc.list_integrations(b.table(spark, sf, "customer").select(
    F.concat(F.lit("i"), "c_custkey").alias("id"), F.concat(F.lit("o"), "c_nationkey").alias("organization_id"),
    F.col("c_acctbal").alias("created_at")), "o7").select("id"), "SELECT 'i' || c_custkey AS id FROM customer WHERE c_nationkey = 7")

# --- webhooks -------------------------------------------------------------------------------

_ACTION = "CASE event_id % 5 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed' WHEN 3 THEN 'reopened' ELSE 'completed' END"
_STATE = "CASE event_id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'suspend' WHEN 2 THEN 'unsuspend' ELSE 'created' END"
WEBHOOK_PAYLOAD = (
    "CASE event_type WHEN 'click' THEN '{\"repository\":{\"id\":' || (user_id % 30) || '}}' "
    f"WHEN 'view' THEN '{{\"action\":\"' || ({_ACTION}) || '\",\"repository\":{{\"id\":' || (user_id % 30) || "
    "'},\"pull_request\":{\"number\":' || (event_id % 40) || '}}' "
    f"WHEN 'error' THEN '{{\"action\":\"' || ({_ACTION}) || '\",\"repository\":{{\"id\":' || (user_id % 30) || '}},\"issue\":{{\"number\":' || "
    "(event_id % 50) || CASE WHEN event_id % 3 = 0 THEN ',\"pull_request\":{\"url\":\"x\"}' ELSE '' END || '}}' "
    f"WHEN 'signup' THEN '{{\"action\":\"' || ({_STATE}) || '\",\"installation\":{{\"id\":' || (event_id % 9) || '}}}}' "
    "ELSE '{\"action\":\"' || CASE WHEN event_id % 3 = 0 THEN 'requested' ELSE 'completed' END || '\",\"repository\":{\"id\":' || (user_id % 30) || "
    "'},\"check_suite\":{\"pull_requests\":[{\"number\":' || (event_id % 40) || '},{\"number\":' || (event_id % 7 + 100) || '}]}}' END")
_KIND = "CASE event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'pull_request' WHEN 'error' THEN 'issues' WHEN 'signup' THEN 'installation' ELSE 'check_suite' END"


def webhook_events(spark, sf):
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("delivery_id"), F.expr(_KIND).alias("event_type"), F.expr(WEBHOOK_PAYLOAD).alias("payload"),
        F.when(F.col("event_id") % 17 != 0, F.col("user_id") % 9).alias("installation_id"))


def directory(spark, sf):
    ev = b.table(spark, sf, "events")
    installations = ev.select((F.col("user_id") % 9).alias("github_installation_id")).distinct().filter("github_installation_id < 8").withColumn(
        "organization_id", F.concat(F.lit("o"), F.col("github_installation_id") % 3))
    repos = ev.select((F.col("user_id") % 30).alias("github_repo_id")).distinct().filter("github_repo_id < 25").select(
        "github_repo_id", F.explode(F.array(F.lit("o0"), F.lit("o1"))).alias("organization_id"))
    return installations, repos.withColumn("id", F.concat_ws("-", "organization_id", "github_repo_id"))


b.CTES["hooks"] = f"""
SELECT event_id, user_id, event_type, {_ACTION} AS action, {_STATE} AS state, 'o' || (user_id % 9 % 3) AS organization_id,
       'o' || (user_id % 9 % 3) || '-' || (user_id % 30) AS repository_id,
       event_id % 17 <> 0 AND user_id % 9 < 8 AND user_id % 9 % 3 < 2 AND user_id % 30 < 25 AS placed FROM events"""
add("wh1_route_webhooks", lambda spark, sf: wh.route_webhooks(webhook_events(spark, sf), *directory(spark, sf)), """
SELECT event_id AS delivery_id, organization_id, repository_id, 'SYNC' AS kind, NULL::INTEGER AS number, NULL::VARCHAR AS detail
FROM hooks WHERE placed AND event_type IN ('click', 'view', 'error')
UNION ALL SELECT event_id, organization_id, repository_id, 'PR_REVIEW', (event_id % 40)::INTEGER,
  'Automated PR review for #' || (event_id % 40) || ' (triggered by ' || action || ')'
FROM hooks WHERE placed AND event_type = 'view' AND action IN ('opened', 'synchronize', 'reopened')
UNION ALL SELECT event_id, organization_id, repository_id, 'ISSUE_TRIAGE', (event_id % 50)::INTEGER,
  'Automated triage for issue #' || (event_id % 50)
FROM hooks WHERE placed AND event_type = 'error' AND action = 'opened' AND event_id % 3 <> 0
UNION ALL SELECT event_id, 'o' || (event_id % 9 % 3), NULL, 'INSTALLATION_STATUS', NULL,
  CASE state WHEN 'deleted' THEN 'UNINSTALLED' WHEN 'suspend' THEN 'SUSPENDED' ELSE 'ACTIVE' END
FROM hooks WHERE event_type = 'signup' AND event_id % 9 < 8 AND state <> 'created'""")


def review_tasks(spark, sf):
    ev = b.table(spark, sf, "events").filter("event_type = 'view'")
    tasks = ev.select(
        F.col("event_id").alias("id"), F.concat(F.lit("o"), F.col("user_id") % 9 % 3).alias("organization_id"),
        F.concat(F.lit("o"), F.col("user_id") % 9 % 3, F.lit("-"), F.col("user_id") % 30).alias("repository_id"),
        (F.col("event_id") % 40).cast("int").alias("pr_number"),
        F.when(F.col("event_id") % 3 == 0, "RUNNING").otherwise("COMPLETED").alias("status"), F.col("ts").alias("created_at"))
    calls = ev.withColumn("position", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        F.col("event_id").alias("task_id"), F.when(F.col("position") == 1, "pr_diff").otherwise("ci_status").alias("tool_name"), "position",
        F.when((F.col("position") == 2) & (F.col("event_id") % 2 == 0), '{"overall":"pending_or_unknown"}').otherwise('{"overall":"passing"}').alias("result"))
    return tasks, calls


add("wh2_reviews_due", lambda spark, sf: wh.reviews_due(webhook_events(spark, sf), *directory(spark, sf), *review_tasks(spark, sf)), """
WITH wanted AS (SELECT event_id AS delivery_id, organization_id, repository_id, unnest([event_id % 40, event_id % 7 + 100])::INTEGER AS pr_number
                FROM hooks WHERE placed AND event_type = 'purchase' AND event_id % 3 <> 0),
tasks AS (SELECT event_id AS id, 'o' || (user_id % 9 % 3) || '-' || (user_id % 30) AS repository_id, (event_id % 40)::INTEGER AS pr_number
          FROM events WHERE event_type = 'view'
          QUALIFY row_number() OVER (PARTITION BY user_id % 9 % 3, user_id % 30, event_id % 40 ORDER BY ts DESC, event_id DESC) = 1)
SELECT w.* FROM wanted w LEFT JOIN tasks t USING (repository_id, pr_number)
WHERE t.id IS NULL OR (t.id % 3 <> 0 AND t.id % 2 = 0)""")
