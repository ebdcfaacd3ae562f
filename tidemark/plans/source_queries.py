"""Scan filters, file columns, raw JSON and the upsert sink over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.plans import bindings as b
from tidemark.plans.delivery_queries import versions
from tidemark.plans.registry import add
from tidemark.session import scratch_path
from tidemark.sources import api, archives, upsert

NAMES = (
    "CASE p_partkey % 8 WHEN 0 THEN 'a/b' || p_partkey || '.py' WHEN 1 THEN 'x/node_modules/c.ts' WHEN 2 THEN '.git/d.py' WHEN 3 THEN 'docs/E' || p_size || '.MD' "
    "WHEN 4 THEN 'f.tsx' WHEN 5 THEN 'README.mdx' WHEN 6 THEN 'build.gradle' ELSE 'src/__init__.py' END")


def listing(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", F.expr(NAMES).alias("path"), (F.col("p_size") * 25000).alias("size_bytes"))


add("src1_keep_sources", lambda spark, sf: archives.keep_sources(listing(spark, sf)), f"""
SELECT p_partkey, path, size_bytes, CASE k WHEN 4 THEN 'typescript' ELSE 'python' END AS language FROM (
  SELECT p_partkey, p_partkey % 8 AS k, {NAMES} AS path, p_size * 25000 AS size_bytes FROM part) WHERE k IN (0, 4, 7) AND size_bytes <= 1000000""")
add("src2_keep_docs", lambda spark, sf: archives.keep_docs(listing(spark, sf)), f"""
SELECT p_partkey, {NAMES} AS path, p_size * 25000 AS size_bytes FROM part WHERE p_partkey % 8 IN (3, 5) AND p_size * 25000 <= 1000000""")


def _url_scan(spark, sf):
    """Page paths as files; an html page counts as a script, as the shared pages have no sources."""
    url_path = F.regexp_extract("url", r"//[^/]+(/[^?#]*)", 1)
    pages = b.table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(url_path, r"\.html$", ".js").alias("path"), F.octet_length("html").alias("size_bytes"))
    return archives.keep_sources(pages).select("page_id", "path", "language")


add("src1_pages_by_url", _url_scan, """
SELECT page_id, regexp_replace(p, '\\.html$', '.js') AS path, 'javascript' AS language
FROM (SELECT page_id, regexp_extract(url, '//[^/]+(/[^?#]*)', 1) AS p FROM pages) WHERE ends_with(p, '.html')""")


def _document_archives(spark, sf):
    """Every 500 documents as an archive; one in six is a file of a kind that is not read."""
    folder = scratch_path(spark, "archives")
    suffix = F.expr("CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.java' WHEN 4 THEN '.png' ELSE '.js' END")
    archives.write_archives(b.table(spark, sf, "documents").select(
        F.concat(F.lit("a"), F.floor(F.col("doc_id") / 500).cast("string")).alias("repository_id"),
        F.concat(F.expr("CASE WHEN doc_id % 11 = 0 THEN 'node_modules/d' ELSE './src/_d' END"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("text").alias("content")), folder)
    return f"{folder}/*.tar.gz"


b.CTES["archived"] = """
SELECT 'a' || (doc_id // 500) AS repository_id, CASE WHEN doc_id % 11 = 0 THEN 'node_modules/d' ELSE 'src/_d' END || doc_id ||
  (['.py', '.ts', '.md', '.java', '.png', '.js'])[doc_id % 6 + 1] AS path, doc_id % 6 AS k, doc_id % 11 = 0 AS ignored, coalesce(text, '') AS content FROM documents"""
add("src1_archive_scan", lambda spark, sf: archives.scan_sources(spark, _document_archives(spark, sf)).select(
    "repository_id", "path", "language", "content_hash", "size_bytes"), """
SELECT repository_id, path, (['python', 'typescript', NULL, 'java', NULL, 'javascript'])[k + 1] AS language, sha256(content) AS content_hash,
       strlen(content)::INTEGER AS size_bytes FROM archived WHERE NOT ignored AND k NOT IN (2, 4) AND strlen(content) <= 1000000""")
add("src2_archive_docs", lambda spark, sf: archives.scan_docs(spark, _document_archives(spark, sf)).select(
    "repository_id", "path", "content_hash", "size_bytes"), """
SELECT repository_id, path, sha256(content) AS content_hash, strlen(content)::INTEGER AS size_bytes FROM archived
WHERE NOT ignored AND k = 2 AND strlen(content) <= 1000000""")
add("src1_archive_skips", lambda spark, sf: archives.skipped_members(spark, _document_archives(spark, sf), [".py", ".ts", ".java", ".js"]), """
SELECT repository_id, path, strlen(content) AS size_bytes, CASE WHEN k IN (2, 4) THEN 'OTHER_SUFFIX' ELSE 'TOO_LARGE' END AS reason FROM archived
WHERE k IN (2, 4) OR strlen(content) > 1000000""")
add("src3_language", lambda spark, sf: archives.with_language(listing(spark, sf)).select("p_partkey", "language"), """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 4 THEN 'typescript' WHEN 7 THEN 'python' END AS language FROM part""")
add("src3_url_suffix", lambda spark, sf: b.table(spark, sf, "pages").select(
    "page_id", paths.extension(F.regexp_replace("url", "[?#].*$", "")).alias("suffix")), """
SELECT page_id, regexp_extract(regexp_replace(url, '^.*/', ''), '^[^?#]*?(\\.[^.?#]+)?([?#]|$)', 1) AS suffix FROM (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
add("src4_file_stats", lambda spark, sf: archives.with_file_stats(b.document_files(spark, sf)).select(
    "path", "content_hash", "size_bytes", "lines_of_code"), """
SELECT path, sha256(content) AS content_hash, strlen(content)::INTEGER AS size_bytes, len(string_split(content, chr(10)))::INTEGER AS lines_of_code FROM doc_files""")
add("src7_raw_json", lambda spark, sf: api.from_api_json(b.table(spark, sf, "events").select(
    "event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body")), "k int"), """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props->>'$.k')::INTEGER END AS k, CASE WHEN event_id % 10 = 0 THEN '{' || props END AS _corrupt FROM events""")


def _round_trip(spark, sf):
    """Creates the table from one version, then upserts the other, twice."""
    path = scratch_path(spark, "documents")
    stored, updates = versions(spark, sf)
    keys = ["repository_id", "path"]
    upsert.write_upsert(stored, path, keys, buckets=8)
    for _ in range(2):
        upsert.write_upsert(updates, path, keys, ["content_hash", "note"], ["note"], [F.col("seq").desc()], buckets=8)
    return upsert.read_table(spark, path).select("repository_id", "path", "content_hash", "note", "origin")


add("src8_upsert_round_trip", _round_trip, """
SELECT repository_id, path, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.note, o.note) AS note, coalesce(o.origin, n.origin) AS origin
FROM ver_old o FULL JOIN ver_new n USING (repository_id, path)""")
