"""Snapshots, symbols, chunks and listings over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths, text as tx
from tidemark.operators import extract as nx, index as ix
from tidemark.operators.containment import FILE
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, quoted
from tidemark.session import land_by

# --- snapshots ------------------------------------------------------------------------------

add("ix1_diff_snapshot", lambda spark, sf: ix.diff_snapshot(*b.snapshots(spark, sf)), """
SELECT repository_id, path, CASE WHEN p.content_hash IS NULL THEN 'added' WHEN c.content_hash IS NULL THEN 'deleted'
  WHEN p.content_hash = c.content_hash THEN 'same' ELSE 'changed' END AS change
FROM snap_prev p FULL JOIN snap_cur c USING (repository_id, path)""")


def _replace(spark, sf):
    previous, current = b.snapshots(spark, sf)
    change = ix.diff_snapshot(previous, current)
    fresh = current.join(change.filter("change IN ('added', 'changed')"), ["repository_id", "path"], "left_semi")
    return ix.apply_snapshot(previous, change.filter("change <> 'same'"), fresh).select("repository_id", "path", "content_hash")


add("ix2_replace_touched", _replace, "SELECT repository_id, path, content_hash FROM snap_cur")


def vector_chunks(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("r"), F.col("vec_id") % 5).alias("repository_id"),
        F.concat(F.lit("f"), F.col("vec_id") % 50).alias("file_path"), F.concat(F.lit("K"), "label").alias("kind"),
        F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))


add("ix22_retract_file_chunks", lambda spark, sf: ix.retract_chunks(
    vector_chunks(spark, sf), vector_chunks(spark, sf).filter("file_path IN ('f1', 'f2')").select("repository_id", "file_path").distinct()).select("id"),
    "SELECT 'v' || vec_id AS id FROM embeddings WHERE vec_id % 50 NOT IN (1, 2)")
add("ix22_retract_repository", lambda spark, sf: ix.retract_chunks(
    vector_chunks(spark, sf), vector_chunks(spark, sf).filter("repository_id = 'r3'").select("repository_id").distinct()).select("id"),
    "SELECT 'v' || vec_id AS id FROM embeddings WHERE vec_id % 5 <> 3")
add("ix22_embedding_status", lambda spark, sf: ix.with_embedding_status(vector_chunks(spark, sf)).groupBy("kind", "embedding_status").agg(
    F.count("*").alias("n")), """
SELECT 'K' || label AS kind, CASE WHEN vec_id % 3 <> 0 THEN 'EMBEDDED' ELSE 'PENDING' END AS embedding_status, count(*) AS n FROM embeddings GROUP BY 1, 2""")

# --- symbols and edges -------------------------------------------------------------------------


def nested_symbols(spark, sf):
    """A parsed file per part: one class, and as many members as its size modulo five."""
    def struct(text, extra=""):
        fields = ["kind", "name", "start_line", "end_line", "signature", "doc_comment", "decorators", "superclasses", "interfaces"]
        return "named_struct(" + ", ".join(f"'{f}', {text[f]}" for f in fields) + extra + ")"

    null = {"signature": "CAST(NULL AS string)", "doc_comment": "CAST(NULL AS string)", "decorators": "CAST(NULL AS array<string>)",
            "superclasses": "CAST(NULL AS string)", "interfaces": "CAST(NULL AS string)"}
    child = struct({**null, "kind": "'METHOD'", "name": "concat('m', i)", "start_line": "i + 2", "end_line": "i + 2"})
    kids = f"transform(sequence(0, p_size % 5), i -> {child})"
    cls = struct({**null, "kind": "'CLASS'", "name": "replace(p_name, ' ', '')", "start_line": "1", "end_line": "p_size"}, f", 'children', {kids}")
    return b.table(spark, sf, "part").selectExpr(
        "p_brand AS repository_id", "concat('f', p_partkey) AS path", "p_type AS doc_comment", "p_size AS line_count", f"array({cls}) AS symbols")


_sha = "sha256(concat_ws(chr(31), {}))"
add("ix3_flatten_symbols", lambda spark, sf: ix.flatten_symbols(nested_symbols(spark, sf)).select(
    "repository_id", "file_path", "id", "parent_id", "kind", "name", "start_line", "end_line", "doc_comment"), f"""
WITH p AS (SELECT *, 'f' || p_partkey AS path, replace(p_name, ' ', '') AS cls FROM part),
ids AS (SELECT *, {_sha.format("p_brand, path, 'MODULE', path, '1'")} AS mid, {_sha.format("p_brand, path, 'CLASS', cls, '1'")} AS cid FROM p)
SELECT p_brand AS repository_id, path AS file_path, mid AS id, NULL AS parent_id, 'MODULE' AS kind, path AS name, 1 AS start_line,
       greatest(p_size, 1) AS end_line, p_type AS doc_comment FROM ids
UNION ALL SELECT p_brand, path, cid, mid, 'CLASS', cls, 1, p_size, NULL FROM ids
UNION ALL SELECT p_brand, path, {_sha.format("p_brand, path, 'METHOD', 'm' || i, (i + 2)::VARCHAR")}, cid, 'METHOD', 'm' || i, (i + 2)::INTEGER, (i + 2)::INTEGER, NULL
FROM (SELECT *, unnest(range(0, p_size % 5 + 1)) AS i FROM ids)""")
add("ix5_heritage_edges", lambda spark, sf: ix.heritage_edges(b.class_symbols(spark, sf)).drop("file_path"), """
SELECT repository_id, id AS source_symbol_id, trim(n, ' ') AS target_package_name, e AS edge_type FROM (
  SELECT repository_id, id, unnest(string_split(superclasses, ',')) AS n, 'EXTENDS' AS e FROM class_symbols WHERE kind <> 'METHOD' AND superclasses IS NOT NULL
  UNION ALL SELECT repository_id, id, unnest(string_split(interfaces, ',')), 'IMPLEMENTS' FROM class_symbols WHERE kind <> 'METHOD' AND interfaces IS NOT NULL)
WHERE trim(n, ' ') <> ''""")


def _target_ids(spark, sf):
    customers = b.table(spark, sf, "customer").select(
        F.expr(b.repository_of("c_custkey")).alias("repository_id"), F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey"))
    stored = customers.filter("c_custkey % 3 <> 0").withColumn("id", F.concat(F.lit("stored"), "path"))
    new = customers.filter("c_custkey % 4 = 0").withColumn("id", F.concat(F.lit("new"), "path"))
    edges = b.graph_edges(spark, sf).select("repository_id", F.col("src").alias("source_symbol_id"), F.col("dst").alias("target_file_path"))
    return ix.attach_target_ids(edges, new, stored)


add("ix7_attach_target_ids", _target_ids, """
SELECT repository_id, src AS source_symbol_id, dst AS target_file_path,
       CASE WHEN dst::BIGINT >= (SELECT count(*) FROM customer) THEN NULL WHEN dst::BIGINT % 4 = 0 THEN 'new' || dst
            WHEN dst::BIGINT % 3 <> 0 THEN 'stored' || dst END AS target_file_id FROM graph""")
add("ix9_join_route", lambda spark, sf: b.table(spark, sf, "pages").select(
    "page_id", paths.join_route(F.regexp_extract("url", "(//[^/?#]*/)", 1), F.regexp_extract("url", "//[^/?#]*(/[^?#]*)", 1)).alias("route"),
    paths.join_route(F.lit(""), F.regexp_extract("url", "//[^/?#]*(/[^?#]*)", 1)).alias("bare")), """
SELECT page_id, '/' || trim(rtrim(regexp_extract(url, '(//[^/?#]*/)', 1), '/') || '/' || ltrim(regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1), '/'), '/') AS route,
       '/' || trim(regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1), '/') AS bare FROM pages""")
add("ix10_express_routes", lambda spark, sf: ix.express_routes(b.ast_nodes(spark, sf)).select("file_path", "method", "path", "start_line"), """
SELECT c.file_path, 'GET' AS method, s.text AS path, c.start_line FROM ast_nodes c
JOIN ast_nodes f ON f.file_path = c.file_path AND f.parent_id = c.node_id AND f.field = 'function' AND f.type = 'member_expression'
JOIN ast_nodes o ON o.file_path = f.file_path AND o.parent_id = f.node_id AND o.field = 'object' AND regexp_matches(o.text, '(?i)(router|app)$')
JOIN ast_nodes p ON p.file_path = f.file_path AND p.parent_id = f.node_id AND p.field = 'property' AND p.text = 'get'
JOIN ast_nodes l ON l.file_path = c.file_path AND l.parent_id = c.node_id AND l.field = 'arguments'
JOIN ast_nodes g ON g.file_path = l.file_path AND g.parent_id = l.node_id AND g.type = 'string'
JOIN ast_nodes s ON s.file_path = g.file_path AND s.parent_id = g.node_id AND s.type = 'string_fragment' AND starts_with(s.text, '/')
WHERE c.type = 'call_expression'""")

# --- frameworks --------------------------------------------------------------------------------

MANIFEST_TEXT = (
    "CASE p_partkey % 3 WHEN 0 THEN concat_ws(chr(10), 'Flask==1.' || p_size, CASE WHEN p_size % 2 = 0 THEN 'djangox==2' ELSE 'django==3' END) "
    "WHEN 1 THEN '{\"dependencies\":{\"next\":\"1\",\"' || CASE WHEN p_size % 3 = 0 THEN '@nestjs/core' ELSE 'react-dom' END || '\":\"2\",\"nextish\":\"1\"}}' "
    "ELSE '<dep>' || CASE WHEN p_size % 2 = 0 THEN 'spring-boot-starter' ELSE 'quarkus' END || '</dep>' END")
MANIFEST_NAME = "CASE p_partkey % 3 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' ELSE 'pom.xml' END"


def framework_manifests(spark, sf):
    return b.table(spark, sf, "part").select(
        F.concat(F.lit("r"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("repository_id"), F.expr(MANIFEST_NAME).alias("path"),
        F.expr(MANIFEST_TEXT).alias("content"))


add("ix11_detect_frameworks", lambda spark, sf: ix.detect_frameworks(framework_manifests(spark, sf)).withColumn(
    "frameworks", F.array_join("frameworks", ",")), """
SELECT 'r' || (p_partkey // 3) AS repository_id, string_agg(DISTINCT f, ',' ORDER BY f) AS frameworks FROM (
  SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN ['Flask'] ELSE ['Flask', 'Django'] END
    WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN ['Next.js', 'NestJS'] ELSE ['Next.js', 'React'] END
    ELSE CASE WHEN p_size % 2 = 0 THEN ['Spring Boot'] ELSE ['Quarkus'] END END) AS f FROM part) GROUP BY 1""")
DOCUMENT_MARKERS = {("text",): {"the": "English", "der": "German", "une": "French", "los": "Spanish", "licence": "Licensed"}}


def document_manifests(spark, sf):
    return b.document_files(spark, sf).withColumn("path", F.concat("path", F.lit("/text")))


add("ix11_words_in_documents", lambda spark, sf: ix.detect_frameworks(document_manifests(spark, sf), DOCUMENT_MARKERS).withColumn(
    "frameworks", F.array_join("frameworks", ",")), """
SELECT repository_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (regexp_matches(lower(content), '\\b' || word || '\\b')), '') AS frameworks
FROM doc_files JOIN (VALUES ('the', 'English'), ('der', 'German'), ('une', 'French'), ('los', 'Spanish'), ('licence', 'Licensed')) m(word, name) ON TRUE
GROUP BY 1""")
add("ix12_sniff_frameworks", lambda spark, sf: ix.sniff_frameworks(framework_manifests(spark, sf)).withColumn(
    "frameworks", F.array_join("frameworks", ",")), f"""
SELECT 'r' || (p_partkey // 3) AS repository_id, coalesce(string_agg(DISTINCT word, ',' ORDER BY word) , '') AS frameworks FROM (
  SELECT p_partkey, word FROM part JOIN (VALUES {", ".join(f"({quoted(w)})" for w in ix.FRAMEWORK_KEYWORDS)}) k(word) ON contains(lower({MANIFEST_TEXT}), word)) GROUP BY 1"""
    .replace("ORDER BY word)", "ORDER BY list_position([" + ", ".join(quoted(w) for w in ix.FRAMEWORK_KEYWORDS) + "], word))").replace("string_agg(DISTINCT word", "string_agg(word")
    .replace("SELECT p_partkey, word FROM part", "SELECT DISTINCT p_partkey // 3 * 3 AS p_partkey, word FROM part"))

# --- chunks ------------------------------------------------------------------------------------


def import_rows(spark, sf):
    part = b.table(spark, sf, "part").withColumn("position", F.explode(F.sequence(F.lit(1), F.col("p_size") % 4 + 1)))
    return part.filter("p_partkey % 5 <> 0").select(
        F.col("p_brand").alias("repository_id"), F.concat(F.lit("f"), "p_partkey").alias("file_path"), "position",
        F.concat(F.lit("mod"), "position").alias("module"),
        F.when(F.col("position") % 2 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), "position"))).otherwise(F.array().cast("array<string>")).alias("imported_names"))


add("ix13_module_chunks", lambda spark, sf: ix.module_chunks(b.table(spark, sf, "part").select(
    F.col("p_brand").alias("repository_id"), F.concat(F.lit("f"), "p_partkey").alias("path"),
    F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("doc_comment")), import_rows(spark, sf)).select(
    "file_path", "kind", "content", "token_count"), """
WITH l AS (SELECT p_partkey, string_agg(CASE WHEN i % 2 = 0 THEN 'from mod' || i || ' import a, b' || i ELSE 'import mod' || i END, chr(10) ORDER BY i) AS t
  FROM (SELECT *, unnest(range(1, p_size % 4 + 2)) AS i FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1),
c AS (SELECT p_partkey, concat_ws(chr(10) || chr(10), CASE WHEN p_partkey % 2 = 0 THEN p_name END, t) AS content
      FROM part LEFT JOIN l USING (p_partkey) WHERE p_partkey % 2 = 0 OR t IS NOT NULL)
SELECT 'f' || p_partkey AS file_path, 'MODULE' AS kind, content, greatest(1, length(content) // 4)::INTEGER AS token_count FROM c""")


def document_symbols(spark, sf):
    """A class and two members per document, over its lines."""
    docs = b.table(spark, sf, "documents")
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return rows.select(
        F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("file_path"), F.concat_ws("-", "doc_id", "n").alias("id"),
        F.when(F.col("n") > 0, F.concat_ws("-", "doc_id", F.lit(0))).alias("parent_id"),
        F.when(F.col("n") == 0, "CLASS").otherwise("METHOD").alias("kind"), F.concat(F.lit("Sym"), "n").alias("name"),
        F.when((F.col("n") != 1) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("sig"), "n", "lang")).alias("signature"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("doc_comment"), (F.col("n") * 2 + 1).alias("start_line"), (F.col("n") * 2 + 2).alias("end_line"))


b.CTES["symbol_base"] = """
SELECT doc_id || '-0' AS key, 1 AS start_line, concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'sig0' || lang ELSE 'class Sym0' END,
  CASE WHEN doc_id % 3 = 0 THEN '\"\"\"' || lang || '\"\"\"' END, '    None', '    ' || CASE WHEN doc_id % 2 = 0 THEN 'sig2' || lang ELSE 'None' END) AS content FROM documents
UNION ALL SELECT doc_id || '-' || n, n * 2 + 1, array_to_string(string_split(text, chr(10))[n * 2 + 1:n * 2 + 2], chr(10)) FROM documents, (VALUES (1), (2)) t(n)"""


def short_line(line):
    return (F.length(line) < 80) & ~line.endswith(".")


b.CTES["sections"] = """
WITH l AS (SELECT repository_id, file_path, line, line_no, length(line) < 80 AND NOT ends_with(line, '.') AS head FROM doc_lines),
m AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY file_path ORDER BY line_no) AS section, bool_or(head) OVER (PARTITION BY file_path) AS any_head FROM l)
SELECT file_path, any_head, min(line_no)::INTEGER AS start_line, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS trimmed,
       string_agg(line, chr(10) ORDER BY line_no) AS raw FROM m GROUP BY file_path, section, any_head"""
b.CTES["section_texts"] = """
SELECT file_path, start_line, CASE WHEN any_head THEN trimmed ELSE raw END AS content FROM sections WHERE NOT any_head OR trimmed <> ''"""


def _window_ctes(name: str, base: str) -> None:
    """`{name}_chunks`: the chunks of `base` (key, start_line, content), cut where they exceed 8,000 characters."""
    b.CTES[f"{name}_sizes"] = f"""
SELECT key, start_line, idx, text, sum(length(text) + 1) OVER (PARTITION BY key, start_line ORDER BY idx) AS upto, n FROM (
  SELECT key, start_line, unnest(string_split(content, chr(10))) AS text, unnest(range(0, len(string_split(content, chr(10))))) AS idx,
         len(string_split(content, chr(10))) AS n FROM {base} WHERE length(content) > 8000)"""
    b.CTES[f"{name}_windows"] = f"""
WITH RECURSIVE w AS (
  SELECT key, start_line, n, 0::BIGINT AS s, coalesce(min(idx + 1) FILTER (upto >= 8000), n)::BIGINT AS e FROM {name}_sizes GROUP BY key, start_line, n
  UNION ALL
  SELECT key, start_line, n, s, coalesce(e, n) FROM (
    SELECT w.key, w.start_line, w.n, greatest(w.e - 5, w.s + 1) AS s,
      (SELECT min(z.idx) + 1 FROM {name}_sizes z WHERE z.key = w.key AND z.start_line = w.start_line AND z.upto >= 8000 +
        (SELECT y.upto FROM {name}_sizes y WHERE y.key = w.key AND y.start_line = w.start_line AND y.idx = greatest(w.e - 5, w.s + 1) - 1)) AS e
    FROM w WHERE w.e < w.n))
SELECT * FROM w"""
    b.CTES[f"{name}_chunks"] = f"""
SELECT key, content, start_line::INTEGER AS start_line, (start_line + length(content) - length(replace(content, chr(10), '')))::INTEGER AS end_line,
       greatest(1, length(content) // 4)::INTEGER AS token_count FROM {base} WHERE length(content) <= 8000
UNION ALL
SELECT key, content, s::INTEGER, e::INTEGER, greatest(1, length(content) // 4)::INTEGER FROM (
  SELECT w.key, (w.start_line + w.s) AS s, (w.start_line + w.e - 1) AS e, (SELECT string_agg(z.text, chr(10) ORDER BY z.idx) FROM {name}_sizes z
    WHERE z.key = w.key AND z.start_line = w.start_line AND z.idx >= w.s AND z.idx < w.e) AS content FROM {name}_windows w)"""


b.CTES["section_base"] = "SELECT file_path AS key, start_line, content FROM section_texts"
b.CTES["document_base"] = "SELECT path AS key, 1 AS start_line, content FROM doc_files"
_window_ctes("section", "section_base")
_window_ctes("document", "document_base")
_window_ctes("symbol", "symbol_base")
CUT = ["start_line", "end_line", "token_count"]
CUT_SQL = "md5(content) AS content_md5, start_line, end_line, token_count"
add("ix14_symbol_chunks", lambda spark, sf: ix.symbol_chunks(document_symbols(spark, sf), b.document_files(spark, sf)).select(
    "symbol_id", F.md5("content").alias("content_md5"), *CUT), f"SELECT key AS symbol_id, {CUT_SQL} FROM symbol_chunks")
add("ix15_section_chunks", lambda spark, sf: ix.section_chunks(b.document_files(spark, sf), short_line).select(
    "file_path", F.md5("content").alias("content_md5"), *CUT), f"SELECT key AS file_path, {CUT_SQL} FROM section_chunks")
add("ix16_split_oversized", lambda spark, sf: ix.split_oversized(b.document_files(spark, sf).select(
    "path", "content", F.lit(1).alias("start_line"))).select("path", F.md5("content").alias("content_md5"), *CUT),
    f"SELECT key AS path, {CUT_SQL} FROM document_chunks")
add("ix17_token_estimate", lambda spark, sf: b.table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens")),
    "SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS tokens FROM documents")

# --- listings ------------------------------------------------------------------------------------

add("ix18_index_status", lambda spark, sf: ix.index_status(
    b.document_files(spark, sf), document_symbols(spark, sf), ix.section_chunks(b.document_files(spark, sf), short_line)), """
SELECT f.repository_id, count(*) AS total_files, 3 * count(*) AS total_symbols,
  (SELECT count(*) FROM section_chunks c JOIN doc_files d ON d.path = c.key WHERE d.repository_id = f.repository_id) AS total_chunks
FROM doc_files f GROUP BY 1""")


def part_symbols(spark, sf):
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("repository_id"), F.col("p_type").alias("file_path"),
        F.when(F.col("p_size") % 2 == 0, "CLASS").otherwise("FUNCTION").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("start_line"))


add("ix19_list_symbols", lambda spark, sf: ix.list_symbols(part_symbols(spark, sf), ["CLASS"]).select("id", "name"),
    "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_size % 2 = 0")
add("ix19_find_symbols", lambda spark, sf: ix.find_symbols(part_symbols(spark, sf), "GEAR", ["CLASS", "FUNCTION"]).select("repository_id", "id", "name"), """
SELECT p_brand AS repository_id, p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_name ILIKE '%gear%'
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size, p_partkey::VARCHAR) <= 5""")
add("ix20_symbol_source", lambda spark, sf: ix.symbol_source(
    document_symbols(spark, sf), b.document_files(spark, sf), 300).select("id", "source", "truncated"), """
SELECT doc_id || '-' || n AS id, left(s, 300) AS source, length(s) > 300 AS truncated FROM (
  SELECT doc_id, n, array_to_string(string_split(text, chr(10))[n * 2 + 1:n * 2 + 2], chr(10)) AS s FROM documents, (VALUES (0), (1), (2)) t(n))""")
add("ix21_list_files", lambda spark, sf: ix.list_files(b.document_files(spark, sf).withColumn("lines_of_code", tx.count_lines(F.col("content")))), """
SELECT repository_id, path, language, len(string_split(content, chr(10)))::INTEGER AS lines_of_code FROM doc_files""")

# --- what trees say -------------------------------------------------------------------------------

b.CTES["tops"] = """
SELECT n.file_path, n.node_id, n.language, n.type, n.node_id AS anchor_id, n.start_line, n.end_line, n.pre FROM ast_nodes n
JOIN ast_nodes r ON r.file_path = n.file_path AND r.node_id = n.parent_id AND r.parent_id IS NULL WHERE n.type NOT IN ('decorated_definition', 'export_statement')
UNION ALL
SELECT n.file_path, n.node_id, n.language, n.type, w.node_id, n.start_line, n.end_line, n.pre FROM ast_nodes w
JOIN ast_nodes r ON r.file_path = w.file_path AND r.node_id = w.parent_id AND r.parent_id IS NULL
JOIN ast_nodes n ON n.file_path = w.file_path AND n.parent_id = w.node_id AND n.field = CASE w.type WHEN 'decorated_definition' THEN 'definition' ELSE 'declaration' END
WHERE w.type IN ('decorated_definition', 'export_statement')"""
b.CTES["top_syms"] = """
SELECT t.file_path, t.node_id, t.anchor_id, t.language, CASE WHEN t.type IN ('function_definition', 'function_declaration') THEN 'FUNCTION'
  WHEN t.type IN ('class_definition', 'class_declaration') THEN 'CLASS' ELSE 'INTERFACE' END AS kind, n.text AS name, t.start_line, t.end_line
FROM tops t JOIN ast_nodes n ON n.file_path = t.file_path AND n.parent_id = t.node_id AND n.field = 'name'
WHERE t.type IN ('function_definition', 'function_declaration', 'class_definition', 'class_declaration', 'interface_declaration')
UNION ALL
SELECT t.file_path, d.node_id, t.anchor_id, t.language, 'FUNCTION', n.text, t.start_line, t.end_line FROM tops t
JOIN ast_nodes d ON d.file_path = t.file_path AND d.parent_id = t.node_id AND d.type = 'variable_declarator'
JOIN ast_nodes v ON v.file_path = d.file_path AND v.parent_id = d.node_id AND v.field = 'value' AND v.type IN ('arrow_function', 'function_expression')
JOIN ast_nodes n ON n.file_path = d.file_path AND n.parent_id = d.node_id AND n.field = 'name' WHERE t.type = 'lexical_declaration'"""
b.CTES["method_syms"] = """
SELECT m.file_path, m.node_id, m.node_id AS anchor_id, c.node_id AS class_id, m.language, n.text AS name, m.start_line, m.end_line
FROM top_syms c JOIN ast_nodes o ON o.file_path = c.file_path AND o.parent_id = c.node_id AND o.field = 'body'
JOIN ast_nodes m ON m.file_path = o.file_path AND m.parent_id = o.node_id AND m.type IN ('function_definition', 'method_definition', 'method_declaration', 'constructor_declaration')
JOIN ast_nodes n ON n.file_path = m.file_path AND n.parent_id = m.node_id AND n.field = 'name' WHERE c.kind = 'CLASS' OR c.language = 'java'
UNION ALL
SELECT m.file_path, m.node_id, w.node_id, c.node_id, m.language, n.text, m.start_line, m.end_line
FROM top_syms c JOIN ast_nodes o ON o.file_path = c.file_path AND o.parent_id = c.node_id AND o.field = 'body'
JOIN ast_nodes w ON w.file_path = o.file_path AND w.parent_id = o.node_id AND w.type = 'decorated_definition'
JOIN ast_nodes m ON m.file_path = w.file_path AND m.parent_id = w.node_id AND m.field = 'definition'
JOIN ast_nodes n ON n.file_path = m.file_path AND n.parent_id = m.node_id AND n.field = 'name' WHERE c.kind = 'CLASS'"""


def symbols_and_methods(spark, sf):
    """Trees with their symbols and methods; symbols are landed once by file, as an index holds them."""
    ast = b.ast_nodes(spark, sf)
    tops = land_by(nx.top_symbols(ast), *FILE, dealt=True)
    return ast, tops, nx.methods(ast, tops)


def everything(spark, sf):
    ast, tops, members = symbols_and_methods(spark, sf)
    return ast, land_by(tops.unionByName(members.drop("class_id")), *FILE, dealt=True)


add("nx1_top_symbols", lambda spark, sf: nx.top_symbols(b.ast_nodes(spark, sf)).select("file_path", "kind", "name", "start_line", "end_line"),
    "SELECT file_path, kind, name, start_line, end_line FROM top_syms")
add("nx2_methods", lambda spark, sf: symbols_and_methods(spark, sf)[2].select("file_path", "class_id", "name", "start_line"),
    "SELECT file_path, class_id, name, start_line FROM method_syms")
add("nx3_imports", lambda spark, sf: nx.imports(b.ast_nodes(spark, sf)).select(
    "file_path", "position", "module", F.array_join("imported_names", "|").alias("names")), """
SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY pos)::INTEGER AS position, replace(module, '#', digit) AS module,
       replace(names, '#', digit) AS names
FROM ast_lines JOIN (VALUES ('python', 1, 'os', ''), ('python', 2, 'numpy', ''), ('python', 3, 'app.db#', 'session|models as m'),
  ('python', 4, '.', '*'), ('javascript', 0, './lib#', 'def#|a|b as c'), ('javascript', 1, 'pkg', '* as ns'), ('javascript', 2, 'mod#', 'one|two'),
  ('java', 0, 'com.acme.Item#', ''), ('java', 1, 'java.util.*', '')) v(language, number, module, names) USING (language, number)""")
add("nx4_decorators", lambda spark, sf: nx.decorators(*everything(spark, sf)).select(
    "file_path", "node_id", F.array_join("decorators", "|").alias("decorators")), """
WITH syms AS (SELECT file_path, node_id, anchor_id, language FROM top_syms UNION ALL SELECT file_path, node_id, anchor_id, language FROM method_syms),
py AS (SELECT s.file_path, s.node_id, d.text, d.pre FROM syms s JOIN ast_nodes d ON d.file_path = s.file_path AND d.parent_id = s.anchor_id AND d.type = 'decorator'
       WHERE s.language = 'python' AND s.anchor_id <> s.node_id),
inn AS (SELECT s.file_path, s.node_id, d.text, d.pre FROM syms s JOIN ast_nodes d ON d.file_path = s.file_path AND d.parent_id = s.anchor_id AND d.type = 'decorator'
        WHERE s.language = 'javascript'),
sib AS (SELECT s.file_path, s.node_id, d.text, d.pre FROM syms s JOIN ast_nodes a ON a.file_path = s.file_path AND a.node_id = s.anchor_id
        JOIN ast_nodes d ON d.file_path = a.file_path AND d.parent_id = a.parent_id AND d.type = 'decorator' AND d.pre < a.pre
        WHERE s.language = 'javascript' AND NOT EXISTS (SELECT 1 FROM ast_nodes x WHERE x.file_path = a.file_path AND x.parent_id = a.parent_id
          AND x.pre > d.pre AND x.pre < a.pre AND x.type <> 'decorator')
          AND (s.file_path, s.node_id) NOT IN (SELECT (file_path, node_id) FROM inn)),
ja AS (SELECT s.file_path, s.node_id, d.text, d.pre FROM syms s JOIN ast_nodes m ON m.file_path = s.file_path AND m.parent_id = s.anchor_id AND m.type = 'modifiers'
       JOIN ast_nodes d ON d.file_path = m.file_path AND d.parent_id = m.node_id AND d.type IN ('marker_annotation', 'annotation') WHERE s.language = 'java')
SELECT file_path, node_id, string_agg(text, '|' ORDER BY pre) AS decorators
FROM (SELECT * FROM py UNION ALL SELECT * FROM inn UNION ALL SELECT * FROM sib UNION ALL SELECT * FROM ja) GROUP BY 1, 2""")
add("nx5_doc_comments", lambda spark, sf: nx.doc_comments(*everything(spark, sf)).groupBy("doc_comment").agg(F.count("*").alias("n")), """
SELECT doc_comment, count(*) AS n FROM ast_lines JOIN (VALUES ('python', 5, 'Fetch one user.'), ('python', 6, 'Keeps things.'),
  ('javascript', 3, 'adds numbers'), ('javascript', 4, 'Order service.' || chr(10) || 'keeps orders'), ('java', 2, 'Holds items.'),
  ('java', 2, 'all items')) v(language, number, doc_comment) USING (language, number) GROUP BY 1""")
add("nx5_module_comments", lambda spark, sf: nx.module_comments(b.ast_nodes(spark, sf)).select("file_path", "doc_comment"), """
SELECT file_path, doc_comment FROM ast_lines JOIN (VALUES ('python', 0, 'module notes'), ('javascript', 0, 'entry point'),
  ('javascript', 3, 'adds numbers'), ('javascript', 4, 'Order service.' || chr(10) || 'keeps orders'), ('java', 2, 'Holds items.'))
  v(language, number, doc_comment) USING (language, number) WHERE pos = 0""")


add("nx6_heritage", lambda spark, sf: nx.heritage(*symbols_and_methods(spark, sf)[:2]).groupBy("superclasses", "interfaces").agg(
    F.count("*").alias("n")), """
SELECT superclasses, interfaces, count(*) AS n FROM ast_lines JOIN (VALUES ('python', 6, 'Base , Mixin', NULL),
  ('javascript', 4, 'Base', 'Handler, Closer'), ('java', 2, 'BaseApi', 'Api, Closeable'), ('java', 3, NULL, 'Root'))
  v(language, number, superclasses, interfaces) USING (language, number) GROUP BY ALL""")


def _signatures(spark, sf):
    ast, symbols = everything(spark, sf)
    return nx.signatures(ast, symbols, b.ast_files(spark, sf)).select("file_path", "node_id", "signature")


add("nx7_signatures", _signatures, """
SELECT s.file_path, s.node_id, regexp_replace(decode(encode(f.content)[n.start_byte + 1:coalesce(o.start_byte, n.end_byte)]),
  CASE s.language WHEN 'python' THEN '[: \\n\\t]+$' WHEN 'java' THEN '[{; \\n\\t]+$' ELSE '[{ \\n\\t]+$' END, '') AS signature
FROM (SELECT file_path, node_id, language FROM top_syms UNION ALL SELECT file_path, node_id, language FROM method_syms) s
JOIN ast_nodes n ON n.file_path = s.file_path AND n.node_id = s.node_id JOIN ast_files f ON f.path = s.file_path
LEFT JOIN ast_nodes o ON o.file_path = s.file_path AND o.parent_id = s.node_id AND o.field = 'body'""")
