"""Model answers that arrive as text: parsed, checked and grounded in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as sc, text as tx

# Allowed recommendation types and priorities, and their defaults.
RECOMMENDATION_TYPES = ["ROLLBACK", "CONFIG_CHANGE", "SCALING", "CACHING", "QUERY_OPTIMIZATION", "INFRA_OPTIMIZATION"]
PRIORITIES = ["LOW", "MEDIUM", "HIGH", "URGENT"]
DEFAULT_TYPE, DEFAULT_PRIORITY, DEFAULT_CONFIDENCE = "CONFIG_CHANGE", "MEDIUM", 50

CLAIM = (
    "summary string, mostLikelyCause string, confidenceScore double, responsibleCommitSha string, "
    "responsiblePullRequestId string, responsibleUserId string, rollbackRecommended string")
RECOMMENDATION = (
    "array<struct<type:string, title:string, description:string, rationale:string, priority:string, "
    "estimatedImpact:string, confidenceScore:double>>")
POSTMORTEM = (
    "executiveSummary string, timelineMarkdown string, rootCauseMarkdown string, contributingFactors string, "
    "customerImpact string, recoverySteps string, lessonsLearned string, actionItems array<struct<description:string>>")


def _filled(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _parsed(raw: DataFrame, shape: str, opening: str, closing: str) -> DataFrame:
    return raw.withColumn("_json", tx.json_text(F.col("raw"), opening, closing)).withColumn(
        "_p", F.from_json("_json", shape)).drop("_json")


def parse_claims(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects) from root-cause answers.

    The answer is the text between the outer braces. A cause and a numeric
    confidence must be there; confidence is held to 0..100.
    """
    p = F.col("_p")
    parsed = _parsed(raw, CLAIM, "{", "}")
    good = F.coalesce(_filled(p["mostLikelyCause"]) & p["confidenceScore"].isNotNull(), F.lit(False))
    truthy = F.coalesce(~p["rollbackRecommended"].isin("false", "0", ""), F.lit(False))
    claims = parsed.filter(good).select(
        "id", F.coalesce(p["summary"], p["mostLikelyCause"]).alias("summary"), p["mostLikelyCause"].alias("most_likely_cause"),
        sc.clamp(p["confidenceScore"], 0.0, 100.0).alias("confidence_score"), p["responsibleCommitSha"].alias("responsible_commit_sha"),
        p["responsiblePullRequestId"].alias("responsible_pull_request_id"), p["responsibleUserId"].alias("responsible_user_id"),
        truthy.alias("rollback_recommended"))
    return claims, parsed.filter(~good).select("id", "raw")


def ground_claims(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """Claims whose references are not among the incident's signals lose them.

    A commit must be the reference of a COMMIT signal; a pull request or user
    may be any reference. An incident has at most nine signals.
    """
    refs = signals.filter("source_ref IS NOT NULL").groupBy(F.col("incident_id").alias("id")).agg(
        F.collect_set("source_ref").alias("_refs"),
        F.collect_set(F.when(F.col("signal_type") == "COMMIT", F.col("source_ref"))).alias("_commits"))
    joined = claims.join(refs, "id", "left")

    def known(column: str, among: str) -> Column:
        return F.when(F.array_contains(among, F.col(column)), F.col(column)).alias(column)

    checked = {"responsible_commit_sha": "_commits", "responsible_pull_request_id": "_refs", "responsible_user_id": "_refs"}
    return joined.select(*[known(c, checked[c]) if c in checked else F.col(c) for c in claims.columns])


def parse_recommendations(raw: DataFrame) -> DataFrame:
    """One row per usable recommendation: title, description and rationale are there."""
    rows = _parsed(raw, RECOMMENDATION, "[", "]").select("id", F.posexplode("_p").alias("position", "r"))
    r = F.col("r")
    usable = _filled(r["title"]) & _filled(r["description"]) & _filled(r["rationale"])
    return rows.filter(usable).select(
        "id", "position", F.when(r["type"].isin(RECOMMENDATION_TYPES), r["type"]).otherwise(DEFAULT_TYPE).alias("type"),
        r["title"].alias("title"), r["description"].alias("description"), r["rationale"].alias("rationale"),
        F.when(r["priority"].isin(PRIORITIES), r["priority"]).otherwise(DEFAULT_PRIORITY).alias("priority"),
        r["estimatedImpact"].alias("estimated_impact"),
        sc.clamp(F.coalesce(r["confidenceScore"], F.lit(float(DEFAULT_CONFIDENCE))), 0.0, 100.0).alias("confidence_score"))


def parse_postmortems(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postmortems, rejects); absent texts read as empty, absent action items as none."""
    p = F.col("_p")
    parsed = _parsed(raw, POSTMORTEM, "{", "}")
    # A malformed object parses to nulls throughout; a well-formed empty one is fine.
    valid = F.coalesce(F.try_parse_json(tx.json_text(F.col("raw"), "{", "}")).isNotNull(), F.lit(False))
    texts = {
        "executiveSummary": "executive_summary", "timelineMarkdown": "timeline_markdown", "rootCauseMarkdown": "root_cause_markdown",
        "contributingFactors": "contributing_factors", "customerImpact": "customer_impact", "recoverySteps": "recovery_steps",
        "lessonsLearned": "lessons_learned"}
    items = F.coalesce(F.transform(p["actionItems"], lambda i: i["description"]), F.array().cast("array<string>"))
    good = parsed.filter(valid).select(
        "id", *[F.coalesce(p[name], F.lit("")).alias(alias) for name, alias in texts.items()], items.alias("action_items"))
    return good, parsed.filter(~valid).select("id", "raw")
