"""Webhook events to the actions they call for; sending them is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import first_per_key, salted_join

# Payload actions that trigger a review or a triage, and status changes.
REVIEW_ACTIONS = ["opened", "synchronize", "reopened"]
TRIAGE_ACTIONS = ["opened"]
REPOSITORY_EVENTS = ["push", "pull_request", "issues", "repository"]
INSTALLATION_STATUS = {"deleted": "UNINSTALLED", "suspend": "SUSPENDED", "unsuspend": "ACTIVE"}
PENDING = "pending_or_unknown"

PAYLOAD = (
    "action string, repository struct<id:bigint>, pull_request struct<number:int>, "
    "issue struct<number:int, pull_request:string>, installation struct<id:bigint>, "
    "check_suite struct<pull_requests:array<struct<number:int>>>"
)


def parse_payloads(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


def _placed(parsed: DataFrame, installations: DataFrame, repositories: DataFrame) -> DataFrame:
    """Events of known installations and imported repositories.

    Both lookups have one row per key; events of a busy repository spread over salts.
    """
    known = installations.select(F.col("github_installation_id").alias("installation_id"), "organization_id")
    repos = repositories.select("organization_id", F.col("github_repo_id").alias("_repo"), F.col("id").alias("repository_id"))
    keyed = parsed.filter(F.col("installation_id").isNotNull() & F.col("p.repository").isNotNull())
    keyed = keyed.withColumn("_repo", F.col("p.repository.id"))
    joined = salted_join(keyed, known, ["installation_id"], ["delivery_id"])
    return salted_join(joined, repos, ["organization_id", "_repo"], ["delivery_id"])


def route_webhooks(events: DataFrame, installations: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row per action: SYNC, PR_REVIEW, ISSUE_TRIAGE or INSTALLATION_STATUS."""
    parsed = parse_payloads(events)
    scoped = _placed(parsed.filter(F.col("event_type").isin(REPOSITORY_EVENTS)), installations, repositories)
    action, pr, issue = F.col("p.action"), F.col("p.pull_request"), F.col("p.issue")
    review = (F.col("event_type") == "pull_request") & pr.isNotNull() & action.isin(REVIEW_ACTIONS)
    triage = (
        (F.col("event_type") == "issues") & issue.isNotNull() & issue["pull_request"].isNull() & action.isin(TRIAGE_ACTIONS))

    def act(kind: str, number, goal) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"), goal.cast("string").alias("detail"))

    actions = F.array_compact(F.array(
        act("SYNC", F.lit(None), F.lit(None)),
        F.when(F.coalesce(review, F.lit(False)), act("PR_REVIEW", pr["number"], F.concat(
            F.lit("Automated PR review for #"), pr["number"].cast("string"), F.lit(" (triggered by "), action, F.lit(")")))),
        F.when(F.coalesce(triage, F.lit(False)), act("ISSUE_TRIAGE", issue["number"], F.concat(
            F.lit("Automated triage for issue #"), issue["number"].cast("string"))))))
    repository_actions = scoped.select("delivery_id", "organization_id", "repository_id", F.explode(actions).alias("a")).select(
        "delivery_id", "organization_id", "repository_id", "a.kind", "a.number", "a.detail")
    status = F.coalesce(*[F.when(action == name, F.lit(value)) for name, value in INSTALLATION_STATUS.items()])
    changes = parsed.filter("event_type = 'installation'").withColumn("detail", status).filter("detail IS NOT NULL")
    known = installations.select(F.col("github_installation_id").alias("_installation"), "organization_id")
    installation_actions = salted_join(
        changes.withColumn("_installation", F.col("p.installation.id")), known, ["_installation"], ["delivery_id"]).select(
        "delivery_id", "organization_id", F.lit(None).cast("string").alias("repository_id"),
        F.lit("INSTALLATION_STATUS").alias("kind"), F.lit(None).cast("int").alias("number"), "detail")
    return repository_actions.unionByName(installation_actions)


def reviews_due(
    events: DataFrame, installations: DataFrame, repositories: DataFrame, tasks: DataFrame, calls: DataFrame,
) -> DataFrame:
    """Pull requests to review again after CI: never reviewed, or last seen pending.

    `tasks` are review tasks (id, organization_id, repository_id, pr_number,
    status, created_at); `calls` their tool calls (task_id, tool_name,
    position, result as JSON).
    """
    suites = parse_payloads(events).filter("event_type = 'check_suite' AND p.action = 'completed'")
    placed = _placed(suites, installations, repositories)
    wanted = placed.select(
        "delivery_id", "organization_id", "repository_id", F.explode("p.check_suite.pull_requests.number").alias("pr_number"))
    key = ["organization_id", "repository_id", "pr_number"]
    latest = first_per_key(tasks, key, [F.col("created_at").desc(), F.col("id").desc()])
    ci = first_per_key(calls.filter("tool_name = 'ci_status'"), ["task_id"], [F.col("position").asc()]).select(
        F.col("task_id").alias("id"), F.get_json_object("result", "$.overall").alias("_overall"))
    reviewed = latest.join(ci, "id", "left").select(*key, F.col("status").alias("_status"), "_overall")
    joined = salted_join(wanted, reviewed, key, ["delivery_id"], "left")
    due = F.col("_status").isNull() | ((F.col("_status") == "COMPLETED") & F.coalesce(F.col("_overall") == PENDING, F.lit(False)))
    return joined.filter(due).select("delivery_id", *key)
