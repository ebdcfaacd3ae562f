"""Packages named by dependency manifests, and what advisories say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores as sc, text as tx
from tidemark.operators.keyed import first_per_key, large_join
from tidemark.operators.rules import finding_rows

# Manifest names, patterns, and advisory severities.
MANIFEST_NAMES = ["package.json", "requirements.txt", "pom.xml"]
NPM_SECTIONS = ["dependencies", "devDependencies"]
VERSION_PREFIX = r"^[\^~>=<\s]+"
PINNED = r"^([A-Za-z0-9_.\-]+)\s*==\s*([A-Za-z0-9_.\-]+)"
MAVEN_BLOCK = r"(?s)<dependency>.*?</dependency>"
MAVEN_FIELDS = {"group": r"<groupId>([^<]+)</groupId>", "artifact": r"<artifactId>([^<]+)</artifactId>", "version": r"<version>([^<]+)</version>"}
ADVISORY_SEVERITY = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "LOW": "LOW"}

MANIFEST = ["repository_id", "path"]


def select_manifests(files: DataFrame) -> DataFrame:
    """Manifests at the root of a repository."""
    return files.filter(F.col("path").isin(MANIFEST_NAMES))


def npm_packages(manifests: DataFrame, leading_digit: bool = False) -> DataFrame:
    """Dependencies and development dependencies; unreadable manifests give none.

    With `leading_digit`, only versions that start with a digit after the
    range prefix is stripped, the rule of the dependency diff.
    """
    shape = ", ".join(f"{section} map<string,string>" for section in NPM_SECTIONS)
    parsed = manifests.filter(F.element_at(F.split("path", "/"), -1) == "package.json").withColumn(
        "_m", F.from_json("content", shape))
    entries = F.concat(*[
        F.coalesce(F.map_entries(F.col(f"_m.{section}")), F.array().cast("array<struct<key:string,value:string>>"))
        for section in NPM_SECTIONS])
    rows = parsed.select(*MANIFEST, F.posexplode(entries).alias("position", "e"))
    version = tx.strip(F.regexp_replace("e.value", VERSION_PREFIX, ""))
    named = rows.select(*MANIFEST, "position", F.col("e.key").alias("name"), version.alias("version"), F.lit("npm").alias("ecosystem"))
    return named.filter(F.col("version").rlike(r"^\d")) if leading_digit else named.filter("version <> ''")


def pypi_packages(manifests: DataFrame) -> DataFrame:
    """Pinned requirements only; comments and ranges give none."""
    lines = manifests.filter(F.element_at(F.split("path", "/"), -1) == "requirements.txt").select(
        *MANIFEST, F.posexplode(tx.text_lines(F.col("content"))).alias("position", "line"))
    line = tx.strip(F.col("line"))
    return lines.filter(line.rlike(PINNED)).select(
        *MANIFEST, "position", F.regexp_extract(line, PINNED, 1).alias("name"), F.regexp_extract(line, PINNED, 2).alias("version"),
        F.lit("PyPI").alias("ecosystem"))


def maven_packages(manifests: DataFrame) -> DataFrame:
    """group:artifact with a literal version; property versions give none."""
    blocks = manifests.filter(F.element_at(F.split("path", "/"), -1) == "pom.xml").select(
        *MANIFEST, F.posexplode(F.regexp_extract_all("content", F.lit(MAVEN_BLOCK), F.lit(0))).alias("position", "block"))
    fields = {name: F.regexp_extract("block", pattern, 1) for name, pattern in MAVEN_FIELDS.items()}
    rows = blocks.select(*MANIFEST, "position", *[c.alias(n) for n, c in fields.items()])
    complete = rows.filter("`group` <> '' AND artifact <> '' AND version <> '' AND NOT startswith(version, '$')")
    return complete.select(*MANIFEST, "position", F.concat("group", F.lit(":"), "artifact").alias("name"), "version", F.lit("Maven").alias("ecosystem"))


def all_packages(manifests: DataFrame, leading_digit: bool = False) -> DataFrame:
    return npm_packages(manifests, leading_digit).unionByName(pypi_packages(manifests)).unionByName(maven_packages(manifests))


def _advice(advisories: DataFrame) -> DataFrame:
    """One row per affected (ecosystem, name, version): first advisory and all ids.

    The advisories of one package version are few; all of them may be many.
    """
    order = F.struct("position", "id", "summary", "severity")
    affected = advisories.select("ecosystem", "name", F.explode("versions").alias("version"), order.alias("a")).distinct()
    listed = affected.groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return listed.select(
        "ecosystem", "name", "version", F.col("a")[0]["id"].alias("top_id"), F.col("a")[0]["summary"].alias("top_summary"),
        F.col("a")[0]["severity"].alias("top_severity"), F.transform("a", lambda x: x["id"]).alias("vuln_ids"))


def unsafe_dependencies(packages: DataFrame, advisories: DataFrame, summary: bool = False) -> DataFrame:
    """A finding per package version that any advisory lists.

    Severity is that of the first advisory; names it does not map are MEDIUM.
    A package that a third of all manifests use is split by adaptive execution.
    With `summary` the metadata also hold that of the first advisory.
    """
    key = ["ecosystem", "name", "version"]
    hits = large_join(packages, _advice(advisories), key)
    severity = sc.lookup(F.upper(F.coalesce("top_severity", F.lit(""))), ADVISORY_SEVERITY, "MEDIUM")
    n = F.size("vuln_ids")
    title = F.concat("name", F.lit("@"), "version", F.lit(" has "), n.cast("string"), F.lit(" known vulnerabilit"),
                     F.when(n == 1, "y").otherwise("ies"))
    return finding_rows(
        hits.withColumn("file_path", F.lit(None).cast("string")), type="UNSAFE_DEPENDENCY", category="DEPENDENCY",
        severity=severity, confidence=90, title=title,
        metadata=F.to_json(F.struct(F.col("name").alias("package"), "version", "vuln_ids",
                                    *([F.col("top_summary").alias("summary")] if summary else []))))


def dependency_diff(base: DataFrame, head: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages of `head` that are new or have another version than in `base`.

    Both are package tables of the same manifests at two refs. Of repeated
    names in `base` the last counts.
    """
    before = first_per_key(base, [*MANIFEST, "name"], [F.col("position").desc()]).select(
        *MANIFEST, "name", F.col("version").alias("previous_version"))
    joined = large_join(head, before, [*MANIFEST, "name"], "left").filter(~F.col("version").eqNullSafe(F.col("previous_version")))
    key = ["ecosystem", "name", "version"]
    return large_join(joined, _advice(advisories).select(*key, "vuln_ids"), key, "left").withColumn(
        "vuln_ids", F.coalesce("vuln_ids", F.array().cast("array<string>")))
