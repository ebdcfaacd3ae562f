"""From alerts to explained incidents: dedup, detection, evidence by time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as sc, text as tx
from tidemark.operators.claims import PRIORITIES
from tidemark.operators.findings import paged
from tidemark.operators.keyed import asof_last, first_per_key, salted_join, top_per_key
from tidemark.session import cut_lineage

# Label severities, open statuses, look-back, relevance scores.
SEVERITY_FROM_LABEL = {"critical": "CRITICAL", "page": "CRITICAL", "high": "HIGH", "warning": "MEDIUM", "info": "LOW"}
OPEN_STATUSES = ["DETECTED", "INVESTIGATING", "ROOT_CAUSED"]
LOOKBACK_MS = 6 * 60 * 60 * 1000
RELEVANCE = {"recent": 90, "prior": 40, "commit": 85, "pull_request": 60, "critical": 70, "high": 55, "owner": 50, "author": 45}
RECENT_FINDINGS = 5
NO_EVIDENCE_SUMMARY = (
    "No deployment, commit, pull request, finding, or ownership evidence could be correlated for this incident.")
NO_EVIDENCE_CAUSE = "Insufficient evidence to determine a root cause"

SERVICE = ["organization_id", "service_id"]
SIGNAL_COLUMNS = ["incident_id", "signal_type", "source_ref", "relevance_score", "summary"]


# --- alerts ---------------------------------------------------------------------------

def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """The first arrival of each (fingerprint, start)."""
    return first_per_key(alerts, ["fingerprint", "starts_at"], [F.col("received_at").asc()])


def alert_severity(labels: Column) -> Column:
    raw = F.lower(F.coalesce(F.try_element_at(labels, F.lit("severity")), F.lit("warning")))
    return sc.lookup(raw, SEVERITY_FROM_LABEL, "MEDIUM")


def alert_title(labels: Column, annotations: Column, service_name: Column) -> Column:
    return F.coalesce(
        tx.non_empty(F.try_element_at(annotations, F.lit("summary"))),
        tx.non_empty(F.try_element_at(labels, F.lit("alertname"))),
        F.concat(F.lit("Incident on "), service_name))


def firing_alerts(alerts: DataFrame, services: DataFrame) -> DataFrame:
    """Firing alerts matched to a registered service of their organization."""
    known = services.select("organization_id", F.col("name").alias("_name"), F.col("id").alias("service_id"))
    firing = alerts.filter(F.col("status") == "firing").withColumn(
        "_name", tx.non_empty(F.try_element_at("labels", F.lit("service"))))
    matched = salted_join(firing.filter(F.col("_name").isNotNull()), known, ["organization_id", "_name"], ["fingerprint"])
    return matched.select(
        "organization_id", "service_id", "fingerprint", F.col("received_at").alias("detected_at"),
        alert_title(F.col("labels"), F.col("annotations"), F.col("_name")).alias("title"),
        alert_severity(F.col("labels")).alias("severity"))


def detect_incidents(
    alerts: DataFrame, services: DataFrame, closes: DataFrame, open_incidents: DataFrame | None = None,
) -> DataFrame:
    """One incident per service and period between closes: its first firing alert.

    `closes` has organization_id, service_id, closed_at. A close at the very
    time of an alert comes first. `open_incidents` (organization_id,
    service_id, detected_at) are already open and swallow later alerts. The
    period of an alert is the last close before it, an as-of lookup that
    splits hot services by time; the first alert per period reduces map-side.
    """
    firing = firing_alerts(alerts, services).withColumn("_existing", F.lit(False))
    if open_incidents is not None:
        opened = open_incidents.select(
            "organization_id", "service_id", F.lit("").alias("fingerprint"), "detected_at",
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("severity"),
            F.lit(True).alias("_existing"))
        firing = firing.unionByName(opened)
    periods = asof_last(firing, closes, SERVICE, "detected_at", "closed_at", [], [], "_close")
    periods = periods.withColumn("_period", F.col("_close.closed_at"))
    first = first_per_key(
        periods, [*SERVICE, "_period"], [F.col("detected_at").asc(), F.col("_existing").desc(), F.col("fingerprint").asc()])
    return first.filter(~F.col("_existing")).select(
        *SERVICE, "fingerprint", "detected_at", "title", "severity", F.lit("DETECTED").alias("status"))


def incident_actor(incidents: DataFrame, services: DataFrame, organizations: DataFrame) -> DataFrame:
    """Who an automatic task runs as: the service's owner, else the organization's."""
    owners = services.select("organization_id", F.col("id").alias("service_id"), F.col("owner_user_id").alias("_owner"))
    leads = organizations.select(F.col("id").alias("organization_id"), F.col("owner_id").alias("_lead"))
    joined = salted_join(incidents, owners, SERVICE, ["id"], "left")
    joined = salted_join(joined, leads, ["organization_id"], ["id"], "left")
    return joined.withColumn("actor_id", F.coalesce("_owner", "_lead")).drop("_owner", "_lead")


# --- correlators ----------------------------------------------------------------------

def with_deployment(incidents: DataFrame, deployments: DataFrame) -> DataFrame:
    """Incidents with the latest deployment of their service at or before detection."""
    return asof_last(
        incidents, deployments, SERVICE, "detected_at", "deployed_at", ["id"],
        ["id", "version", "commit_sha", "environment", "status"], "deployment")


def deployment_label(deployment: Column) -> Column:
    return F.coalesce(deployment["version"], F.substring(deployment["commit_sha"], 1, 7), deployment["id"])


def deployment_signals(matched: DataFrame) -> DataFrame:
    """Signals from `with_deployment` rows: 90 within six hours, else 40."""
    deployment = F.col("deployment")
    age_ms = F.unix_millis("detected_at") - F.unix_millis(deployment["deployed_at"])
    recent = age_ms <= LOOKBACK_MS
    minutes = sc.round_half_up(age_ms / F.lit(60000)).cast("string")
    summary = F.concat(
        F.when(recent, "Recent").otherwise("Prior"), F.lit(" deployment "), deployment_label(deployment), F.lit(' to "'),
        deployment["environment"], F.lit('" '), minutes, F.lit("m before detection (status: "), deployment["status"], F.lit(")."))
    return matched.filter(deployment.isNotNull()).select(
        F.col("id").alias("incident_id"), F.lit("DEPLOYMENT").alias("signal_type"), deployment["id"].alias("source_ref"),
        F.when(recent, RELEVANCE["recent"]).otherwise(RELEVANCE["prior"]).alias("relevance_score"), summary.alias("summary"))


def with_commit(matched: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds the deployed commit of the incident's repository as struct `commit`."""
    known = commits.select(
        "repository_id", F.col("sha").alias("_sha"),
        F.struct("sha", "message", "author_name", "author_email", "author_login").alias("commit"))
    # Commits are a large table: repeating them per salt would cost more than a hot key, which adaptive execution splits.
    keyed = matched.withColumn("_sha", F.col("deployment.commit_sha"))
    # Incidents without a deployed commit skip the join, or they would all meet in one task.
    without = keyed.filter("_sha IS NULL").withColumn("commit", F.lit(None).cast(known.schema["commit"].dataType))
    return keyed.filter("_sha IS NOT NULL").join(known, ["repository_id", "_sha"], "left").unionByName(without).drop("_sha")


def commit_signals(with_commits: DataFrame) -> DataFrame:
    commit = F.col("commit")
    summary = F.concat(
        F.lit("Deployed commit "), F.substring(commit["sha"], 1, 7), F.lit(" by "),
        F.coalesce(commit["author_login"], commit["author_name"]), F.lit(': "'),
        F.split_part(commit["message"], F.lit("\n"), F.lit(1)), F.lit('"'))
    return with_commits.filter(commit.isNotNull()).select(
        F.col("id").alias("incident_id"), F.lit("COMMIT").alias("signal_type"), commit["sha"].alias("source_ref"),
        F.lit(RELEVANCE["commit"]).alias("relevance_score"), summary.alias("summary"))


def pull_request_signals(matched: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """The latest pull request merged at or before the deployment, else the detection."""
    anchored = matched.withColumn("_before", F.coalesce("deployment.deployed_at", "detected_at"))
    merged = pull_requests.filter("state = 'MERGED'")
    found = asof_last(anchored, merged, ["repository_id"], "_before", "merged_at", ["id"],
                      ["id", "number", "title", "author_login"], "pr").filter("pr IS NOT NULL")
    pr = F.col("pr")
    summary = F.concat(
        F.lit("Most recently merged PR before this deployment: #"), pr["number"].cast("string"), F.lit(' "'), pr["title"],
        F.lit('" by '), pr["author_login"], F.lit(" (best-effort match - not a confirmed merge-commit link)."))
    return found.select(
        F.col("id").alias("incident_id"), F.lit("PULL_REQUEST").alias("signal_type"), pr["id"].alias("source_ref"),
        F.lit(RELEVANCE["pull_request"]).alias("relevance_score"), summary.alias("summary"))


def finding_signals(
    incidents: DataFrame, findings: DataFrame, latest_only: bool = False, analyses: DataFrame | None = None,
) -> DataFrame:
    """The newest five HIGH or CRITICAL findings of the repository.

    Over all analyses by default; `latest_only` keeps those of each
    repository's newest completed analysis.
    """
    grave = findings.filter(F.col("severity").isin("HIGH", "CRITICAL"))
    if latest_only:
        newest = first_per_key(analyses.filter("status = 'COMPLETED'"), ["repository_id"], [F.col("started_at").desc()])
        grave = salted_join(grave, newest.select(F.col("id").alias("analysis_id")), ["analysis_id"], ["id"], "left_semi")
    newest_five = top_per_key(grave, ["repository_id"], [F.col("created_at").desc(), F.col("id").desc()], RECENT_FINDINGS)
    text = F.concat(
        F.lit("Existing "), F.col("severity"), F.lit(" "), F.lower("category"), F.lit(' finding: "'), F.col("title"), F.lit('"'),
        F.when(F.col("file_path").isNotNull(), F.concat(F.lit(" ("), "file_path", F.lit(")"))).otherwise(""))
    score = F.when(F.col("severity") == "CRITICAL", RELEVANCE["critical"]).otherwise(RELEVANCE["high"])
    small = newest_five.select(
        "repository_id", F.col("id").alias("source_ref"), score.alias("relevance_score"), text.alias("summary"))
    wide = incidents.select("repository_id", F.col("id").alias("incident_id"))
    return salted_join(wide, small, ["repository_id"], ["incident_id"]).withColumn(
        "signal_type", F.lit("FINDING")).select(*SIGNAL_COLUMNS)


def ownership_signals(with_commits: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """The service's owner, else the account of the deployed commit's author."""
    owners = services.select("organization_id", F.col("id").alias("service_id"), F.col("owner_user_id").alias("_owner_id"))
    by_id = users.select(F.col("id").alias("_owner_id"), F.struct("id", "name", "email").alias("_owner"))
    by_email = first_per_key(users, ["email"], [F.col("id").asc()]).select(
        F.col("email").alias("_email"), F.struct("id", "name", "email").alias("_author"))
    joined = salted_join(with_commits, owners, SERVICE, ["id"], "left")
    joined = salted_join(joined, by_id, ["_owner_id"], ["id"], "left")
    joined = salted_join(joined.withColumn("_email", F.col("commit.author_email")), by_email, ["_email"], ["id"], "left")
    owner, author = F.col("_owner"), F.col("_author")
    return joined.filter(owner.isNotNull() | author.isNotNull()).select(
        F.col("id").alias("incident_id"), F.lit("OWNERSHIP").alias("signal_type"),
        F.coalesce(owner["id"], author["id"]).alias("source_ref"),
        F.when(owner.isNotNull(), RELEVANCE["owner"]).otherwise(RELEVANCE["author"]).alias("relevance_score"),
        F.when(owner.isNotNull(), F.concat(F.lit("Service owner: "), owner["name"], F.lit(" ("), owner["email"], F.lit(")")))
        .otherwise(F.concat(F.lit("Deploying commit's author (also an organization member): "), author["name"])).alias("summary"))


def correlate(
    incidents: DataFrame, services: DataFrame, deployments: DataFrame, commits: DataFrame, pull_requests: DataFrame,
    findings: DataFrame, users: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, timeline, incidents with their deployment filled in).

    Signals are keyed by (incident, type, ref), so a rerun replaces them.
    """
    # Five correlators read this table: it is computed once and read back.
    with_commits = cut_lineage(with_commit(with_deployment(incidents, deployments), commits))
    matched = with_commits.drop("commit")
    parts = [
        deployment_signals(matched), commit_signals(with_commits), pull_request_signals(matched, pull_requests),
        ownership_signals(with_commits, services, users), finding_signals(incidents, findings),
    ]
    signals = reduce(DataFrame.unionByName, [part.select(*SIGNAL_COLUMNS) for part in parts]).dropDuplicates(
        ["incident_id", "signal_type", "source_ref"])
    deployment = F.col("deployment")
    shipped = matched.filter(deployment.isNotNull()).select(
        F.col("id").alias("incident_id"), deployment["deployed_at"].alias("occurred_at"),
        F.lit("DEPLOYMENT").alias("event_type"),
        F.concat(F.lit("Deployment "), deployment_label(deployment), F.lit(' to "'), deployment["environment"], F.lit('"')).alias("description"),
        deployment["id"].alias("source_ref"))
    detected = matched.select(
        F.col("id").alias("incident_id"), F.col("detected_at").alias("occurred_at"),
        F.lit("INCIDENT_DETECTED").alias("event_type"), F.col("title").alias("description"),
        F.lit(None).cast("string").alias("source_ref"))
    attached = matched.withColumn("deployment_id", F.coalesce("deployment_id", "deployment.id")).drop("deployment")
    return signals, shipped.unionByName(detected), attached


# --- reading back ---------------------------------------------------------------------

def list_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy("incident_id", F.col("relevance_score").desc(), "signal_type", "source_ref")


def list_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("incident_id", "occurred_at", "event_type")


def default_root_causes(incidents: DataFrame, signals: DataFrame) -> DataFrame:
    """A zero-confidence conclusion for each incident without any signal."""
    bare = incidents.join(signals.select(F.col("incident_id").alias("id")).distinct(), "id", "left_anti")
    return bare.select(
        F.col("id").alias("incident_id"), F.lit(NO_EVIDENCE_SUMMARY).alias("summary"),
        F.lit(NO_EVIDENCE_CAUSE).alias("most_likely_cause"), F.lit(0).alias("confidence_score"),
        F.col("service_id").alias("responsible_service_id"), F.lit(False).alias("rollback_recommended"))


def blast_radius(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """Per incident, how many other services share its organization and repository.

    The services themselves are one lookup away by (organization_id,
    repository_id), see `affected_services`; pairing every incident with every
    service of a large repository would square it.
    """
    homes = services.select("organization_id", F.col("id").alias("service_id"), F.col("repository_id").alias("_repository"))
    sizes = services.filter(F.col("repository_id").isNotNull()).groupBy(
        "organization_id", F.col("repository_id").alias("_repository")).agg(
        F.count("*").alias("_size"), F.count_if(F.col("criticality").isin("HIGH", "CRITICAL")).alias("_critical"))
    one = services.select("organization_id", F.col("id").alias("service_id"),
                          F.col("criticality").isin("HIGH", "CRITICAL").cast("int").alias("_self_critical"))
    placed = homes.join(one, SERVICE).join(sizes, ["organization_id", "_repository"], "left")
    joined = salted_join(incidents.select("id", *SERVICE), placed, SERVICE, ["id"], "left")
    return joined.select(
        F.col("id").alias("incident_id"), *SERVICE, F.col("_repository").alias("repository_id"),
        F.coalesce(F.col("_size") - 1, F.lit(0)).alias("affected_services"),
        F.coalesce(F.col("_critical") - F.col("_self_critical"), F.lit(0)).alias("critical_services"))


def affected_services(incidents: DataFrame, services: DataFrame) -> DataFrame:
    """The other services of the repositories that incidents hit, by the service hit (`service_id`).

    Incidents reduce to their distinct services first, so the answer grows
    with the service catalogue and not with the incidents.
    """
    hit = incidents.select("organization_id", F.col("service_id").alias("id")).distinct()
    home = services.join(hit, ["organization_id", "id"]).select("organization_id", "repository_id", F.col("id").alias("service_id"))
    return services.join(home, ["organization_id", "repository_id"]).filter(F.col("id") != F.col("service_id")).select(
        "service_id", "id", "name", "criticality")


def service_health(services: DataFrame, snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """Health per service: the live reading where one exists, else the latest snapshot.

    Of readings at one time the largest counts, field by field.
    """
    def newest(df: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
        return df.groupBy("service_id").agg(F.max(F.struct("captured_at", *fields)).alias(name))

    joined = (
        services.select(F.col("id").alias("service_id"))
        .join(newest(snapshots, "_snap", ["error_rate", "p95_latency_ms", "risk_score"]), "service_id", "left")
        .join(newest(live, "_live", ["error_rate", "p95_latency_ms"]), "service_id", "left"))
    is_live = F.col("_live").isNotNull()

    def pick(name: str) -> Column:
        return F.when(is_live, F.col(f"_live.{name}")).otherwise(F.col(f"_snap.{name}")).alias(name)

    return joined.select(
        "service_id", F.when(is_live, "live").otherwise("snapshot").alias("source"), pick("captured_at"),
        pick("error_rate"), pick("p95_latency_ms"),
        F.when(~is_live, F.col("_snap.risk_score")).alias("risk_score"))


def rollback_summary(incidents: DataFrame, root_causes: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Whether to roll back, why, and the ROLLBACK recommendations of the incident.

    One root cause exists per incident, and one answer's few recommendations.
    """
    causes = root_causes.select(
        F.col("incident_id").alias("id"), "most_likely_cause", "confidence_score", "rollback_recommended")
    advice = recommendations.filter(F.col("type") == "ROLLBACK").groupBy(F.col("incident_id").alias("id")).agg(
        F.sort_array(F.collect_list("title")).alias("recommendations"))
    joined = incidents.select("id", "deployment_id").join(causes, "id", "left").join(advice, "id", "left")
    known = F.col("most_likely_cause").isNotNull()
    flagged = F.coalesce("rollback_recommended", F.lit(False))
    reason = (
        F.when(~known, "Root cause analysis has not run yet for this incident.")
        .when(flagged, F.concat(
            F.lit("Root cause analysis (confidence "), F.col("confidence_score").cast("string"), F.lit("%) points to: "),
            F.col("most_likely_cause")))
        .otherwise("Root cause analysis did not flag this incident as needing a rollback."))
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias("incident_id"), flagged.alias("rollback_recommended"), reason.alias("reason"),
        F.when(known, F.col("deployment_id")).alias("responsible_deployment_id"),
        F.when(known, F.coalesce("recommendations", none)).otherwise(none).alias("recommendations"))


def list_incidents(
    incidents: DataFrame, status: str | None = None, severity: str | None = None, service_id: str | None = None,
    page: int = 1, page_size: int = 20,
) -> DataFrame:
    rows = incidents
    for name, value in (("status", status), ("severity", severity), ("service_id", service_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return paged(rows, [F.col("detected_at").desc(), F.col("id").asc()], page, page_size)


def _gathered(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Ordered list of `value` per incident. Correlation bounds its length: nine signals, two timeline rows."""
    entry = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], value.alias("v"))
    return df.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name))


def _priority_place(priority: Column) -> Column:
    return -sc.lookup(priority, {name: i for i, name in enumerate(PRIORITIES)}, 0)


def incident_dossier(
    incidents: DataFrame, signals: DataFrame, timeline: DataFrame, root_causes: DataFrame, recommendations: DataFrame,
) -> DataFrame:
    """Each incident with its signals, timeline, cause and recommendations nested."""
    evidence = _gathered(
        signals, [-F.col("relevance_score"), F.col("signal_type"), F.col("source_ref")],
        F.struct("signal_type", "source_ref", "relevance_score", "summary"), "signals")
    events = _gathered(
        timeline, [F.col("occurred_at"), F.col("event_type")], F.struct("occurred_at", "event_type", "description"), "timeline")
    advice = _gathered(
        recommendations, [_priority_place(F.col("priority")), F.col("title")], F.struct("type", "priority", "title", "description"),
        "recommendations")
    causes = root_causes.select("incident_id", F.struct(
        "most_likely_cause", "confidence_score", "rollback_recommended").alias("root_cause"))
    rows = incidents.withColumnRenamed("id", "incident_id")
    for part in (evidence, events, advice, causes):
        rows = rows.join(part, "incident_id", "left")
    return rows


def postmortem_evidence(dossier: DataFrame) -> DataFrame:
    """The evidence text of each incident that has a root cause."""
    def block(items: Column, line) -> Column:
        return F.coalesce(tx.non_empty(F.array_join(F.transform(items, line), "\n")), F.lit("(none)"))

    cause = F.col("root_cause")
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    text = F.concat(
        F.lit("Incident: "), "title", F.lit(" (severity "), "severity", F.lit(")\nRoot cause: "), cause["most_likely_cause"],
        F.lit(" (confidence "), cause["confidence_score"].cast("string"), F.lit("%)\nRollback recommended: "),
        cause["rollback_recommended"].cast("string"), F.lit("\n\nTimeline:\n"),
        block(F.col("timeline"), lambda t: F.concat(
            F.lit("- "), F.date_format(t["occurred_at"], stamp), F.lit(": "), t["description"])),
        F.lit("\n\nEvidence:\n"),
        block(F.col("signals"), lambda s: F.concat(F.lit("- ["), s["signal_type"], F.lit("] "), s["summary"])),
        F.lit("\n\nRecommendations:\n"),
        block(F.col("recommendations"), lambda r: F.concat(
            F.lit("- ["), r["priority"], F.lit("] "), r["title"], F.lit(": "), r["description"])))
    return dossier.filter(cause.isNotNull()).select("incident_id", text.alias("evidence_text"))


def list_services(services: DataFrame, organization_id: str | None = None) -> DataFrame:
    rows = services if organization_id is None else services.filter(F.col("organization_id") == organization_id)
    return rows.orderBy("organization_id", "name")


def list_integrations(integrations: DataFrame, organization_id: str | None = None) -> DataFrame:
    rows = integrations if organization_id is None else integrations.filter(F.col("organization_id") == organization_id)
    return rows.orderBy("organization_id", F.col("created_at").desc(), "id")
