"""Vector search, context, conversations and model answers over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import claims as cl, incidents as inc, retrieval as rt
from tidemark.plans import bindings as b
from tidemark.plans.incident_queries import correlated, matched
from tidemark.plans.registry import add, quoted

# --- search -----------------------------------------------------------------------------------


def chunks(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("r"), F.col("vec_id") % 5).alias("repository_id"), F.concat(F.lit("K"), "label").alias("kind"),
        "embedding")


def queries(spark, sf):
    """Every fiftieth vector is a question to all of them."""
    return b.table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _shown(hits):
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def _search_sql(where: str, k: int) -> str:
    return f"""
SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id)::INTEGER AS rank, round(s, 5) AS score
FROM (SELECT q.vec_id, e.vec_id AS eid, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s
      FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON {where}) q JOIN embeddings e ON e.vec_id = q.eid QUALIFY rank <= {k}"""


add("rt1_vector_search", lambda spark, sf: _shown(rt.search(chunks(spark, sf), queries(spark, sf))), _search_sql("TRUE", 10))
add("rt1_filtered_search", lambda spark, sf: _shown(rt.search(
    chunks(spark, sf), queries(spark, sf), 4, ["r1", "r3"], ["K1", "K2", "K3"])), _search_sql("e.vec_id % 5 IN (1, 3) AND e.label IN (1, 2, 3)", 4))
add("rt1_search_in_blocks", lambda spark, sf: _shown(rt.search(chunks(spark, sf), queries(spark, sf), 10, chunk_rows=120, query_rows=4)), _search_sql("TRUE", 10))


def repositories(spark, sf):
    return chunks(spark, sf).select(F.col("repository_id").alias("id")).distinct().select(
        "id", F.when(F.col("id").isin("r0", "r2"), "o1").otherwise("o2").alias("organization_id"), F.concat(F.lit("repo "), "id").alias("name"))


add("rt2_organization_search", lambda spark, sf: _shown(rt.search_organization(
    chunks(spark, sf), repositories(spark, sf), "o2", queries(spark, sf))), _search_sql("e.vec_id % 5 IN (1, 3, 4)", 10))
add("rt4_documentation_search", lambda spark, sf: _shown(rt.search_docs(chunks(spark, sf), queries(spark, sf), kind="K2")), _search_sql("e.label = 2", 5))


def _hydrated(spark, sf):
    docs = b.table(spark, sf, "documents").filter("doc_id % 7 <> 0").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("r"), F.col("doc_id") % 5).alias("repository_id"), F.concat(F.lit("f"), "doc_id").alias("file_path"),
        F.col("lang").alias("kind"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("symbol_id"))
    symbols = docs.filter("symbol_id % 4 = 0").select(F.col("symbol_id").alias("id"), F.concat(F.lit("S"), "symbol_id").alias("name"))
    return rt.hydrate(rt.search(chunks(spark, sf), queries(spark, sf)), docs, symbols, repositories(spark, sf))


b.CTES["search_hits"] = _search_sql("TRUE", 10)
b.CTES["hydrated"] = """
SELECT query_id, rank, chunk_id, 'r' || (doc_id % 5) AS repository_id, 'repo r' || (doc_id % 5) AS repository_name, 'f' || doc_id AS file_path, lang AS kind,
       CASE WHEN doc_id % 4 = 0 THEN 'S' || doc_id END AS symbol_name, text AS content FROM search_hits JOIN documents ON doc_id = chunk_id WHERE doc_id % 7 <> 0"""
add("rt3_hydrate", lambda spark, sf: _hydrated(spark, sf).drop("score"), "SELECT * FROM hydrated")


def document_hits(spark, sf):
    return b.table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id"), F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("repository_name"),
        F.col("lang").alias("kind"), F.col("text").alias("content"))


def packed(spark, sf):
    return rt.pack_context(document_hits(spark, sf), order=[F.col("doc_id").asc()])


b.CTES["packed"] = """
SELECT * FROM (SELECT *, row_number() OVER w AS place, sum(length(text) + 200) OVER w AS chars_used FROM documents
  WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE place = 1 OR chars_used <= 24000"""
add("rt5_pack_context", lambda spark, sf: packed(spark, sf).select("query_id", "doc_id", "place", "chars_used"),
    "SELECT source AS query_id, doc_id, place::INTEGER AS place, chars_used::BIGINT AS chars_used FROM packed")
add("rt6_render_context", lambda spark, sf: rt.render_context(packed(spark, sf)).select("query_id", F.md5("context").alias("context_md5")), """
SELECT source AS query_id, md5(string_agg('<context file="' || doc_id || '" repository="' || source || '" kind="' || lang || '">' || chr(10) || text
  || chr(10) || '</context>', chr(10) || chr(10) ORDER BY place)) AS context_md5 FROM packed GROUP BY 1""")

# --- citations ----------------------------------------------------------------------------------

RESULT = (
    "CASE event_id % 7 "
    "WHEN 0 THEN '[{\"filePath\":\"a' || (event_id % 9) || '\",\"repositoryId\":\"r1\",\"chunkId\":\"c' || event_id || '\"},{\"filePath\":7,\"repositoryId\":\"r\"},{\"filePath\":\"z\"}]' "
    "WHEN 1 THEN '{\"filePath\":\"b' || (event_id % 9) || '\",\"repositoryId\":\"r2\",\"chunkId\":5}' "
    "WHEN 2 THEN '{\"found\":true,\"matches\":[{\"filePath\":\"m' || event_id || '\",\"repositoryId\":\"r3\"},\"text\"]}' "
    "WHEN 3 THEN '{\"matches\":{\"filePath\":\"no\",\"repositoryId\":\"r\"}}' WHEN 4 THEN 'not json' WHEN 5 THEN '\"text\"' ELSE '[]' END")
b.CTES["cites"] = """
SELECT event_id, 'a' || (event_id % 9) AS file_path, 'r1' AS repository_id, 'c' || event_id AS chunk_id FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'b' || (event_id % 9), 'r2', NULL FROM events WHERE event_id % 7 = 1
UNION ALL SELECT event_id, 'm' || event_id, 'r3', NULL FROM events WHERE event_id % 7 = 2"""


def tool_results(spark, sf):
    return b.table(spark, sf, "events").select("event_id", (F.col("event_id") % 100).alias("message_id"), F.col("event_id").alias("position"),
                                               F.expr(RESULT).alias("result"))


add("rt7_extract_citations", lambda spark, sf: rt.extract_citations(tool_results(spark, sf)).select("event_id", "file_path", "repository_id", "chunk_id"),
    "SELECT * FROM cites")
add("rt8_dedupe_citations", lambda spark, sf: rt.dedupe_citations(rt.extract_citations(tool_results(spark, sf))).select(
    "message_id", "file_path", "event_id", "chunk_id"), """
SELECT event_id % 100 AS message_id, file_path, event_id, chunk_id FROM cites QUALIFY row_number() OVER (PARTITION BY event_id % 100, file_path ORDER BY event_id DESC) = 1""")


def words(spark, sf):
    """Each word of a message cites the file of that name, at its place in the text."""
    return b.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("position", "file_path"))


add("rt8_last_mention_of_a_word", lambda spark, sf: rt.dedupe_citations(words(spark, sf)), """
SELECT message_id, max(position)::INTEGER AS position, file_path FROM (
  SELECT conv_id || '-' || turn AS message_id, unnest(w) AS file_path, unnest(range(0, len(w))) AS position
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]+') AS w FROM conversations)) GROUP BY message_id, file_path""")

# --- conversations --------------------------------------------------------------------------------


def messages(spark, sf):
    return b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", F.concat_ws("-", "conv_id", "turn").alias("message_id"), "role", F.col("text").alias("content"))


add("rt9_recent_history", lambda spark, sf: rt.recent_history(messages(spark, sf)).select("conversation_id", "turn", "role"), """
SELECT conv_id AS conversation_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
WHERE n BETWEEN 2 AND 15 AND role IN ('user', 'assistant')""")


def _detail(spark, sf):
    msgs = messages(spark, sf)
    calls = msgs.filter("role = 'assistant'").withColumn("position", F.explode(F.sequence(F.lit(0), F.col("turn") % 3))).select(
        "message_id", "position", F.concat(F.lit("tool"), "position").alias("tool_name"), F.lit("{}").alias("arguments"), F.lit("[]").alias("result"),
        F.lit("SUCCESS").alias("status"), F.col("turn").alias("duration_ms"))
    cites = rt.dedupe_citations(words(spark, sf)).withColumn("repository_id", F.lit("r"))
    return rt.conversation_detail(msgs, calls, cites)


add("rt10_conversation_detail", lambda spark, sf: _detail(spark, sf).select(
    "conversation_id", "turn", "role", F.array_join(F.transform("tool_invocations", lambda t: t["tool_name"]), ",").alias("tools"),
    F.array_join(F.transform("citations", lambda c: c["file_path"]), ",").alias("files")), """
SELECT conv_id AS conversation_id, turn, role,
  CASE WHEN role = 'assistant' THEN array_to_string(list_transform(range(0, turn % 3 + 1), lambda i: 'tool' || i), ',') END AS tools,
  nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-z]+'))), ','), '') AS files
FROM conversations""")
add("rt11_list_conversations", lambda spark, sf: rt.list_conversations(b.table(spark, sf, "conversations").groupBy(
    F.col("conv_id").alias("id"), F.concat(F.lit("o"), F.col("conv_id") % 3).alias("organization_id"), (F.col("conv_id") % 2).alias("user_id")).agg(
    F.max("turn").alias("updated_at")), "o1", 0), """
SELECT conv_id AS id, 'o' || (conv_id % 3) AS organization_id, conv_id % 2 AS user_id, max(turn) AS updated_at FROM conversations
WHERE conv_id % 3 = 1 AND conv_id % 2 = 0 GROUP BY 1""")


def _unindexed(spark, sf):
    questions = b.table(spark, sf, "documents").select((F.col("doc_id") * 5).alias("query_id"), F.concat(F.lit("r"), F.col("doc_id") % 9).alias("repository_id"))
    hits = rt.search(chunks(spark, sf), queries(spark, sf), 3)
    return rt.unindexed_questions(questions, hits, chunks(spark, sf).filter("kind <> 'K0'"))


add("rt12_unindexed_questions", _unindexed, """
SELECT doc_id * 5 AS query_id, 'r' || (doc_id % 9) AS repository_id FROM documents WHERE doc_id * 5 NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)
  AND doc_id % 9 NOT IN (SELECT vec_id % 5 FROM embeddings WHERE label <> 0)""")

# --- model answers ----------------------------------------------------------------------------------

CLAIM_TEXT = (
    "CASE event_id % 6 WHEN 0 THEN 'no json here' WHEN 1 THEN 'Sure: {\"mostLikelyCause\":\"c' || event_id || '\",\"confidenceScore\":' || (event_id % 150) || "
    "',\"responsibleCommitSha\":\"' || (event_id - 1) || '\",\"rollbackRecommended\":true} done' "
    "WHEN 2 THEN '{\"mostLikelyCause\":\"\",\"confidenceScore\":5}' WHEN 3 THEN '{\"summary\":\"s\",\"mostLikelyCause\":\"c\",\"confidenceScore\":-4,\"responsibleUserId\":\"u' || "
    "(user_id % 20) || '\",\"responsiblePullRequestId\":\"p' || event_id || '\"}' WHEN 4 THEN '{\"mostLikelyCause\":\"c\",\"confidenceScore\":\"80\"}' "
    "ELSE chr(10) || '{\"mostLikelyCause\":\"c\",' || chr(10) || '\"confidenceScore\":12.5,\"rollbackRecommended\":false}' END")


def answers(spark, sf):
    return b.events(spark, sf, "error").select(F.concat(F.lit("i"), "event_id").alias("id"), F.expr(CLAIM_TEXT).alias("raw"))


b.CTES["claims_ev"] = """
SELECT 'i' || event_id AS id, CASE event_id % 6 WHEN 1 THEN 'c' || event_id WHEN 3 THEN 's' ELSE 'c' END AS summary,
  CASE event_id % 6 WHEN 1 THEN 'c' || event_id ELSE 'c' END AS most_likely_cause,
  CASE event_id % 6 WHEN 1 THEN least(event_id % 150, 100)::DOUBLE WHEN 3 THEN 0.0 ELSE 12.5 END AS confidence_score,
  CASE WHEN event_id % 6 = 1 THEN (event_id - 1)::VARCHAR END AS responsible_commit_sha,
  CASE WHEN event_id % 6 = 3 THEN 'p' || event_id END AS responsible_pull_request_id,
  CASE WHEN event_id % 6 = 3 THEN 'u' || (user_id % 20) END AS responsible_user_id, event_id % 6 = 1 AS rollback_recommended
FROM ev WHERE event_type = 'error' AND event_id % 6 IN (1, 3, 5)"""
add("rt14_parse_claims", lambda spark, sf: cl.parse_claims(answers(spark, sf))[0], "SELECT * FROM claims_ev")
add("rt14_rejected_claims", lambda spark, sf: cl.parse_claims(answers(spark, sf))[1].select("id"),
    "SELECT 'i' || event_id AS id FROM ev WHERE event_type = 'error' AND event_id % 6 NOT IN (1, 3, 5)")
add("rt13_ground_claims", lambda spark, sf: cl.ground_claims(cl.parse_claims(answers(spark, sf))[0], correlated(spark, sf)[0]), """
SELECT id, summary, most_likely_cause, confidence_score,
  CASE WHEN EXISTS (SELECT 1 FROM sig_commit s WHERE s.incident_id = c.id AND s.source_ref = c.responsible_commit_sha) THEN responsible_commit_sha END AS responsible_commit_sha,
  CASE WHEN EXISTS (SELECT 1 FROM sig_all s WHERE s.incident_id = c.id AND s.source_ref = c.responsible_pull_request_id) THEN responsible_pull_request_id END
    AS responsible_pull_request_id,
  CASE WHEN EXISTS (SELECT 1 FROM sig_owner s WHERE s.incident_id = c.id AND s.source_ref = c.responsible_user_id) THEN responsible_user_id END AS responsible_user_id,
  rollback_recommended FROM claims_ev c""")
ADVICE_TEXT = (
    "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'Here: [{\"type\":\"ROLLBACK\",\"title\":\"t' || event_id || '\",\"description\":\"d\",\"rationale\":\"r\",\"priority\":\"URGENT\","
    "\"confidenceScore\":' || (event_id % 200) || '},{\"title\":\"\",\"description\":\"d\",\"rationale\":\"r\"}]' "
    "WHEN 2 THEN '[{\"type\":\"OTHER\",\"title\":\"t\",\"description\":\"d\",\"rationale\":\"r\",\"priority\":\"now\",\"estimatedImpact\":\"big\"}]' ELSE '[]' END")
add("rt15_parse_recommendations", lambda spark, sf: cl.parse_recommendations(b.events(spark, sf, "error").select(
    F.concat(F.lit("i"), "event_id").alias("id"), F.expr(ADVICE_TEXT).alias("raw"))), """
SELECT 'i' || event_id AS id, 0 AS position, 'ROLLBACK' AS type, 't' || event_id AS title, 'd' AS description, 'r' AS rationale, 'URGENT' AS priority,
       NULL AS estimated_impact, least(event_id % 200, 100)::DOUBLE AS confidence_score FROM ev WHERE event_type = 'error' AND event_id % 4 = 1
UNION ALL SELECT 'i' || event_id, 0, 'CONFIG_CHANGE', 't', 'd', 'r', 'MEDIUM', 'big', 50.0 FROM ev WHERE event_type = 'error' AND event_id % 4 = 2""")
POSTMORTEM_TEXT = (
    "CASE event_id % 3 WHEN 0 THEN 'x {\"executiveSummary\":\"e' || event_id || '\",\"actionItems\":[{\"description\":\"a\"},{\"description\":\"b\"}]} y' "
    "WHEN 1 THEN '{\"timelineMarkdown\":\"t\",\"actionItems\":\"none\"}' ELSE '{broken' END")


def postmortem_answers(spark, sf):
    return b.events(spark, sf, "error").select(F.concat(F.lit("i"), "event_id").alias("id"), F.expr(POSTMORTEM_TEXT).alias("raw"))


add("rt16_parse_postmortems", lambda spark, sf: cl.parse_postmortems(postmortem_answers(spark, sf))[0].select(
    "id", "executive_summary", "timeline_markdown", "customer_impact", F.array_join("action_items", ",").alias("action_items")), """
SELECT 'i' || event_id AS id, CASE event_id % 3 WHEN 0 THEN 'e' || event_id ELSE '' END AS executive_summary,
       CASE event_id % 3 WHEN 1 THEN 't' ELSE '' END AS timeline_markdown, '' AS customer_impact,
       CASE event_id % 3 WHEN 0 THEN 'a,b' ELSE '' END AS action_items FROM ev WHERE event_type = 'error' AND event_id % 3 < 2""")
add("rt16_rejected_postmortems", lambda spark, sf: cl.parse_postmortems(postmortem_answers(spark, sf))[1].select("id"),
    "SELECT 'i' || event_id AS id FROM ev WHERE event_type = 'error' AND event_id % 3 = 2")


def _evidence(spark, sf):
    retrieved = b.table(spark, sf, "documents").select(
        F.col("source").alias("key"), F.col("doc_id").alias("position"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    called = b.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("key"), F.col("turn").alias("position"), F.col("role").alias("tool_name"), F.lit("{}").alias("arguments"),
        F.col("text").alias("result"))
    return rt.evidence_lines(retrieved, called)


add("rt17_evidence_lines", _evidence, """
SELECT source AS key, 'chunk' AS source, doc_id AS position, doc_id || ': ' || left(text, 1000) AS line FROM documents
UNION ALL SELECT 'c' || conv_id, 'call', turn, role || '({}) -> ' || left(text, 1000) FROM conversations""")
