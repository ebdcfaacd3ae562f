"""Tree metrics over web pages and over the trees that parts stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import patterns, scores, trees
from tidemark.operators.containment import FILE
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, quoted
from tidemark.session import land_by

HTML = b.PAGE_ROLES


def listed(names) -> str:
    return ", ".join(quoted(x) for x in names)


def role_sql(role: str, alias: str = "") -> str:
    """The role test over sample trees, written out per language."""
    dot = f"{alias}." if alias else ""
    tests = [f"({dot}language = {quoted(lang)} AND {dot}type IN ({listed(table[role])}))"
             for lang, table in trees.NODE_ROLES.items() if table.get(role) and lang != "typescript"]
    return "(" + " OR ".join(tests) + ")"




def pages(spark, sf):
    """Page trees, landed once by file: a metric reads its nodes several times, and no step moves them."""
    return land_by(b.page_trees(spark, sf), *FILE, dealt=True)


# --- web pages -----------------------------------------------------------------------

_h = HTML["html"]
b.CTES["pf"] = f"""
SELECT repository_id, file_path, node_id AS function_id, pre, post, start_line, end_line
FROM page_trees WHERE type IN ({listed(_h["function"])})"""
KEYS = [*FILE, "function_id"]

add("tm1_functions", lambda spark, sf: trees.functions(pages(spark, sf), HTML).select(
    *KEYS, "pre", "post", "function_name", "start_line", "end_line"),
    "SELECT *, '<anonymous>' AS function_name FROM pf")
add("tm1_named_functions", lambda spark, sf: trees.functions(b.ast_nodes(spark, sf)).groupBy("language", "function_name").agg(
    F.count("*").alias("n"), F.sum("start_line").alias("lines")), f"""
SELECT f.language, coalesce(n.text, '<anonymous>') AS function_name, count(*) AS n, sum(f.start_line)::BIGINT AS lines
FROM ast_nodes f LEFT JOIN ast_nodes n ON n.file_path = f.file_path AND n.parent_id = f.node_id AND n.field = 'name'
WHERE {role_sql("function", "f")} GROUP BY ALL""")
b.CTES["page_cx"] = f"""
SELECT f.*, (1 + count(n.node_id))::INTEGER AS complexity FROM pf f LEFT JOIN page_trees n
  ON n.file_path = f.file_path AND n.pre BETWEEN f.pre AND f.post AND n.type IN ({listed(_h["decision"])}) GROUP BY ALL"""
add("tm2_complexity", lambda spark, sf: trees.complexity(pages(spark, sf), HTML).select(*KEYS, "complexity"),
    "SELECT repository_id, file_path, function_id, complexity FROM page_cx")
b.CTES["ast_cx"] = f"""
SELECT f.repository_id, f.file_path, f.language, f.node_id AS function_id,
       (1 + count(n.node_id) FILTER ({role_sql("decision", "n")})
          + count(n.node_id) FILTER (n.type = 'boolean_operator' OR (n.type = 'binary_expression' AND o.type IN ('&&', '||', '??'))))::INTEGER
         AS complexity
FROM ast_nodes f JOIN ast_nodes n ON n.file_path = f.file_path AND n.pre BETWEEN f.pre AND f.post
LEFT JOIN ast_nodes o ON o.file_path = n.file_path AND o.parent_id = n.node_id AND o.field = 'operator'
WHERE {role_sql("function", "f")} GROUP BY ALL"""
add("tm2_complexity_code", lambda spark, sf: trees.complexity(b.ast_nodes(spark, sf)).select(*KEYS, "complexity"),
    "SELECT repository_id, file_path, function_id, complexity FROM ast_cx")
add("tm3_high_complexity", lambda spark, sf: trees.high_complexity(trees.complexity(pages(spark, sf), HTML)).select(
    "file_path", "severity", "title", "start_line"), """
SELECT file_path, CASE WHEN complexity > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       '`<anonymous>` has high cyclomatic complexity (' || complexity || ')' AS title, start_line FROM page_cx WHERE complexity > 10""")
add("tm4_long_method", lambda spark, sf: trees.long_method(trees.functions(pages(spark, sf), HTML), 20, 40).select(
    "file_path", "severity", "title", "start_line", "end_line"), """
SELECT file_path, CASE WHEN end_line - start_line + 1 > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       '`<anonymous>` is a long method (' || (end_line - start_line + 1) || ' lines)' AS title, start_line, end_line
FROM pf WHERE end_line - start_line + 1 > 20""")


def _depth_oracle(role: str, name: str) -> str:
    return f"""
WITH inside AS (SELECT f.repository_id, f.file_path, f.function_id, n.node_id, (SELECT count(*) FROM page_trees a
    WHERE a.file_path = f.file_path AND a.type IN ({listed(_h[role])}) AND n.pre BETWEEN a.pre AND a.post
      AND a.pre > f.pre AND a.pre <= f.post) AS depth
  FROM pf f LEFT JOIN page_trees n ON n.file_path = f.file_path AND n.pre > f.pre AND n.pre <= f.post)
SELECT repository_id, file_path, function_id, coalesce(max(depth), 0)::INTEGER AS {name} FROM inside GROUP BY 1, 2, 3"""


add("tm6_nesting_depth", lambda spark, sf: trees.nesting_depth(pages(spark, sf), HTML).select(*KEYS, "depth"),
    _depth_oracle("nesting", "depth"))
add("tm6_deep_nesting", lambda spark, sf: trees.deep_nesting(trees.nesting_depth(pages(spark, sf), HTML), 1).select(
    "file_path", "title"), f"""
SELECT file_path, '`<anonymous>` has deeply nested control flow (' || depth || ' levels)' AS title
FROM ({_depth_oracle("nesting", "depth")}) WHERE depth > 1""")
add("tm15_loop_depth", lambda spark, sf: trees.loop_depth(pages(spark, sf), HTML).select(*KEYS, "loop_depth"),
    _depth_oracle("loop", "loop_depth"))
add("tm15_expensive_loops", lambda spark, sf: trees.expensive_loops(trees.loop_depth(b.ast_nodes(spark, sf))).select(
    "file_path", "title", "start_line"), f"""
SELECT f.file_path, '`' || max(n.text) || '` has 3 nested loops' AS title, f.start_line FROM ast_nodes f
JOIN ast_nodes n ON n.file_path = f.file_path AND n.parent_id = f.node_id AND n.field = 'name'
JOIN ast_nodes a ON a.file_path = f.file_path AND a.pre BETWEEN f.pre AND f.post AND {role_sql("loop", "a")}
JOIN ast_nodes c ON c.file_path = f.file_path AND c.pre > a.pre AND c.pre <= a.post AND {role_sql("loop", "c")}
JOIN ast_nodes d ON d.file_path = f.file_path AND d.pre > c.pre AND d.pre <= c.post AND {role_sql("loop", "d")}
WHERE {role_sql("function", "f")} GROUP BY f.file_path, f.node_id, f.start_line""")
add("tm7_large_file", lambda spark, sf: trees.large_file(b.document_files(spark, sf).withColumn(
    "lines_of_code", tx.count_lines(F.col("content"))), 10, 40).select("file_path", "severity", "title"), """
SELECT path AS file_path, CASE WHEN n > 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, path || ' is a large file (' || n || ' lines)' AS title
FROM (SELECT path, len(string_split(content, chr(10))) AS n FROM doc_files) WHERE n > 10""")
b.CTES["page_shapes"] = """
SELECT f.repository_id, f.file_path, f.function_id, f.start_line, f.end_line, sha256(string_agg(n.type, '|' ORDER BY n.pre)) AS fingerprint
FROM pf f JOIN page_trees n ON n.file_path = f.file_path AND n.pre BETWEEN f.pre AND f.post GROUP BY ALL"""
add("tm8_fingerprint", lambda spark, sf: trees.fingerprint(pages(spark, sf), HTML).select(*KEYS, "fingerprint"),
    "SELECT repository_id, file_path, function_id, fingerprint FROM page_shapes")
add("tm9_duplicates", lambda spark, sf: trees.duplicates(trees.fingerprint(pages(spark, sf), HTML)).select(
    "repository_id", "title", "file_path", "start_line"), """
SELECT repository_id, 'Duplicate logic found in ' || count(*) || ' functions' AS title, arg_min(file_path, (file_path, start_line)) AS file_path,
       arg_min(start_line, (file_path, start_line)) AS start_line
FROM page_shapes WHERE end_line - start_line + 1 >= 5 GROUP BY repository_id, fingerprint HAVING count(*) > 1""")
add("tm9_duplicate_locations", lambda spark, sf: trees.duplicate_locations(trees.fingerprint(pages(spark, sf), HTML)).select(
    "repository_id", "fingerprint", "members", "file_path", "start_line"), """
SELECT repository_id, fingerprint, members, file_path, start_line FROM (
  SELECT *, count(*) OVER (PARTITION BY repository_id, fingerprint) AS members FROM page_shapes WHERE end_line - start_line + 1 >= 5)
WHERE members > 1""")


def document_copies(spark, sf):
    docs = b.document_files(spark, sf)
    return docs.select(
        F.lit("all").alias("repository_id"), F.col("path").alias("file_path"), F.lit(0).alias("function_id"),
        F.col("path").alias("function_name"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
        tx.content_hash(F.col("content")).alias("fingerprint"))


add("tm9_repeated_documents", lambda spark, sf: trees.duplicates(document_copies(spark, sf)).select("file_path", "title"), """
SELECT min(path) AS file_path, 'Duplicate logic found in ' || count(*) || ' functions' AS title
FROM doc_files GROUP BY sha256(content) HAVING count(*) > 1""")

# --- names and literals in sample trees --------------------------------------------------

add("tm10_unused_variables", lambda spark, sf: trees.unused_variables(b.ast_nodes(spark, sf)).select(
    "file_path", "symbol_name", "title", "start_line"), f"""
SELECT f.file_path, coalesce(fn.text, '<anonymous>') AS symbol_name,
       'Unused variable `' || v.text || '` in `' || coalesce(fn.text, '<anonymous>') || '`' AS title, v.start_line
FROM ast_nodes f JOIN ast_nodes s ON s.file_path = f.file_path AND s.pre BETWEEN f.pre AND f.post
  AND ((s.language = 'python' AND s.type = 'assignment') OR (s.language = 'javascript' AND s.type = 'variable_declarator'))
JOIN ast_nodes v ON v.file_path = s.file_path AND v.parent_id = s.node_id AND v.type = 'identifier'
  AND v.field = CASE s.language WHEN 'python' THEN 'left' ELSE 'name' END
LEFT JOIN ast_nodes fn ON fn.file_path = f.file_path AND fn.parent_id = f.node_id AND fn.field = 'name'
WHERE {role_sql("function", "f")} AND NOT starts_with(v.text, '_') AND v.text NOT IN ('self', 'this', 'cls')
  AND len(list_filter(regexp_extract_all(f.text, '\\w+'), lambda w: w = v.text)) <= 1""")


def first_word_imports(spark, sf):
    """The first ASCII word of each document plays a name it imports."""
    word = F.regexp_extract("content", "[A-Za-z_]+", 0)
    return b.document_files(spark, sf).select(
        "repository_id", F.col("path").alias("file_path"), F.lit("m").alias("module"),
        F.array(F.concat(F.lit("pkg.x as "), word), F.lit("*")).alias("imported_names"))


add("tm11_unused_imports", lambda spark, sf: trees.unused_imports(first_word_imports(spark, sf), b.document_files(spark, sf)).select(
    "file_path", "title"), """
WITH names AS (SELECT path, content, regexp_extract(content, '[A-Za-z_]+') AS name FROM doc_files)
SELECT path AS file_path, 'Unused import `' || name || '` in ' || path AS title FROM names
WHERE name <> '' AND len(list_filter(regexp_extract_all(content, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: w = name)) <= 1""")
b.CTES["ast_calls"] = f"""
SELECT c.*, coalesce(n.text, CASE WHEN f.type IN ('attribute', 'member_expression') THEN p.text ELSE f.text END) AS callee
FROM ast_nodes c LEFT JOIN ast_nodes n ON n.file_path = c.file_path AND n.parent_id = c.node_id AND n.field = 'name'
LEFT JOIN ast_nodes f ON f.file_path = c.file_path AND f.parent_id = c.node_id AND f.field = 'function'
LEFT JOIN ast_nodes p ON p.file_path = f.file_path AND p.parent_id = f.node_id AND p.field IN ('attribute', 'property')
WHERE {role_sql("call", "c")}"""
b.CTES["ast_functions"] = f"""
SELECT f.*, coalesce(n.text, '<anonymous>') AS function_name FROM ast_nodes f
LEFT JOIN ast_nodes n ON n.file_path = f.file_path AND n.parent_id = f.node_id AND n.field = 'name' WHERE {role_sql("function", "f")}"""
b.CTES["ast_loops"] = f"SELECT * FROM ast_nodes WHERE {role_sql('loop')}"
add("tm13_calls", lambda spark, sf: trees.calls(b.ast_nodes(spark, sf)).select("file_path", "node_id", "callee"),
    "SELECT file_path, node_id, callee FROM ast_calls WHERE callee IS NOT NULL")
add("tm12_n_plus_one", lambda spark, sf: trees.n_plus_one(b.ast_nodes(spark, sf)).select(
    "file_path", "title", "start_line", "metadata"), f"""
SELECT f.file_path, 'Possible N+1 query in `' || f.function_name || '`' AS title, l.start_line,
       '{{"callee":"' || arg_min(c.callee, c.pre) || '"}}' AS metadata
FROM ast_functions f JOIN ast_loops l ON l.file_path = f.file_path AND l.pre BETWEEN f.pre AND f.post
JOIN ast_calls c ON c.file_path = l.file_path AND c.pre BETWEEN l.pre AND l.post AND c.callee IN ({listed(trees.QUERY_CALLEES)})
GROUP BY f.file_path, f.node_id, f.function_name, l.node_id, l.start_line""")


def page_links(spark, sf):
    """`a` tags as calls named by their text, through a name child."""
    nodes = pages(spark, sf)
    names = nodes.filter("type = 'a'").withColumn("parent_id", F.col("node_id")).withColumn(
        "node_id", -F.col("node_id") - 1).withColumn("type", F.lit("name")).withColumn("field", F.lit("name"))
    return nodes.unionByName(names)


add("tm12_links_in_lists", lambda spark, sf: trees.n_plus_one(page_links(spark, sf), HTML, ["The", "the", "and", "of", "to", "de", "la"]).select(
    "file_path", "start_line", "metadata"), f"""
SELECT f.file_path, l.start_line, '{{"callee":"' || arg_min(c.text, c.pre) || '"}}' AS metadata
FROM pf f JOIN page_trees l ON l.file_path = f.file_path AND l.pre BETWEEN f.pre AND f.post AND l.type IN ('ul', 'li')
JOIN page_trees c ON c.file_path = l.file_path AND c.pre BETWEEN l.pre AND l.post AND c.type = 'a'
  AND c.text IN ('The', 'the', 'and', 'of', 'to', 'de', 'la')
GROUP BY f.file_path, f.function_id, l.node_id, l.start_line""")
add("tm14_blocking_calls", lambda spark, sf: trees.blocking_calls(b.ast_nodes(spark, sf)).select("file_path", "title", "start_line"), """
SELECT f.file_path, 'Blocking call `' || c.callee || '` inside async function `' || f.function_name || '`' AS title, c.start_line
FROM ast_functions f JOIN ast_calls c ON c.file_path = f.file_path AND c.pre BETWEEN f.pre AND f.post
WHERE starts_with(ltrim(left(f.text, 20)), 'async') AND (ends_with(c.callee, 'Sync') OR c.callee = 'sleep')""")
add("tm16_literal_sizes", lambda spark, sf: trees.literal_sizes(pages(spark, sf), HTML).select(*FILE, "node_id", "elements"), """
SELECT l.repository_id, l.file_path, l.node_id, CASE WHEN count(c.node_id) FILTER (c.type = 'li') > 0 THEN count(c.node_id) FILTER (c.type = 'li')
       ELSE count(c.node_id) FILTER (c.is_named) END AS elements
FROM page_trees l LEFT JOIN page_trees c ON c.file_path = l.file_path AND c.parent_id = l.node_id WHERE l.type = 'ul' GROUP BY ALL""")
add("tm17_large_literals", lambda spark, sf: trees.large_literals(trees.literal_sizes(pages(spark, sf), HTML), 6).select(
    "file_path", "title", "evidence"), """
SELECT l.file_path, 'Large inline literal (' || count(*) || ' elements) in ' || l.file_path AS title, count(*) || ' inline elements' AS evidence
FROM page_trees l JOIN page_trees c ON c.file_path = l.file_path AND c.parent_id = l.node_id AND c.type = 'li'
WHERE l.type = 'ul' GROUP BY l.file_path, l.node_id HAVING count(*) >= 6""")
add("tm18_inefficient_collections", lambda spark, sf: trees.inefficient_collections(b.ast_nodes(spark, sf)).select(
    "file_path", "symbol_name", "confidence", "evidence", "start_line"), """
SELECT f.file_path, f.function_name AS symbol_name, 40 AS confidence, c.callee || '() called inside a loop' AS evidence, c.start_line
FROM ast_functions f JOIN ast_loops l ON l.file_path = f.file_path AND l.pre BETWEEN f.pre AND f.post
JOIN ast_calls c ON c.file_path = l.file_path AND c.pre BETWEEN l.pre AND l.post AND c.callee IN ('includes', 'indexOf', 'contains')
UNION ALL
SELECT f.file_path, f.function_name, 35, '`in` operator used inside a loop', c.start_line
FROM ast_functions f JOIN ast_loops l ON l.file_path = f.file_path AND l.pre BETWEEN f.pre AND f.post
JOIN ast_nodes c ON c.file_path = l.file_path AND c.pre BETWEEN l.pre AND l.post AND c.type = 'comparison_operator'
  AND EXISTS (SELECT 1 FROM ast_nodes k WHERE k.file_path = c.file_path AND k.parent_id = c.node_id AND k.type = 'in')
WHERE f.language = 'python'""")
add("tm19_unnecessary_objects", lambda spark, sf: trees.unnecessary_objects(b.ast_nodes(spark, sf)).select(
    "file_path", "symbol_name", "start_line"), """
WITH lits AS (SELECT * FROM ast_nodes WHERE type IN ('dictionary', 'list', 'object', 'array')),
seen AS (SELECT f.file_path, f.node_id AS fid, f.function_name, l.node_id AS lid, l.pre AS lpre, l.post AS lpost, x.node_id AS xid, x.pre AS xpre,
                x.post AS xpost, x.start_line
         FROM ast_functions f JOIN ast_loops l ON l.file_path = f.file_path AND l.pre BETWEEN f.pre AND f.post
         JOIN lits x ON x.file_path = l.file_path AND x.pre BETWEEN l.pre AND l.post
         QUALIFY row_number() OVER (PARTITION BY f.file_path, f.node_id, x.start_byte ORDER BY l.pre, x.node_id) = 1),
ids AS (SELECT file_path, pre, text FROM ast_nodes WHERE type IN ('identifier', 'property_identifier')),
head AS (SELECT l.file_path, l.node_id AS lid, i.text FROM ast_loops l JOIN ids i ON i.file_path = l.file_path AND i.pre BETWEEN l.pre AND l.post
         LEFT JOIN ast_nodes y ON y.file_path = l.file_path AND y.parent_id = l.node_id AND y.field = 'body'
         WHERE y.node_id IS NULL OR i.pre NOT BETWEEN y.pre AND y.post)
SELECT file_path, function_name AS symbol_name, start_line FROM seen s
WHERE EXISTS (SELECT 1 FROM ast_nodes k WHERE k.file_path = s.file_path AND k.parent_id = s.xid AND k.is_named)
  AND NOT EXISTS (SELECT 1 FROM ids i JOIN head h ON h.file_path = i.file_path AND h.text = i.text
                  WHERE i.file_path = s.file_path AND i.pre BETWEEN s.xpre AND s.xpost AND h.lid = s.lid)""")


def cached_files(spark, sf):
    """Sample files; every fifth one mentions a cache."""
    return b.ast_files(spark, sf).withColumn(
        "content", F.when(F.substring("path", 2, 20).cast("bigint") % 5 == 0, F.concat("content", F.lit(" lru_cache")))
        .otherwise(F.replace("content", F.lit("cache"), F.lit("store"))))


add("tm20_missing_caching", lambda spark, sf: trees.missing_caching(b.ast_nodes(spark, sf), cached_files(spark, sf)).select(
    "file_path", "title", "evidence"), f"""
SELECT f.file_path, '`' || f.function_name || '` may benefit from caching' AS title,
       'Getter-style function calling ' || arg_min(c.callee, c.pre) || '(), no memoization found in file' AS evidence
FROM ast_functions f JOIN ast_calls c ON c.file_path = f.file_path AND c.pre BETWEEN f.pre AND f.post AND c.callee IN ({listed(trees.QUERY_CALLEES)})
WHERE regexp_matches(lower(f.function_name), '^(get|fetch|load|find)') AND substr(f.file_path, 2)::BIGINT % 5 <> 0
  AND (SELECT count(*) FROM ast_nodes p JOIN ast_nodes k ON k.file_path = p.file_path AND k.parent_id = p.node_id AND k.is_named
       WHERE p.file_path = f.file_path AND p.parent_id = f.node_id AND p.field = 'parameters') <= 1
GROUP BY f.file_path, f.node_id, f.function_name""")
add("tm21_heavy_queries", lambda spark, sf: trees.heavy_queries(b.ast_nodes(spark, sf)).select("file_path", "title", "start_line"), f"""
SELECT file_path, '`' || callee || '()` called with no filter/limit in ' || file_path AS title, start_line FROM ast_calls c
WHERE callee IN ({listed(trees.QUERY_CALLEES)}) AND NOT EXISTS (
  SELECT 1 FROM ast_nodes p JOIN ast_nodes k ON k.file_path = p.file_path AND k.parent_id = p.node_id AND k.is_named
  WHERE p.file_path = c.file_path AND p.parent_id = c.node_id AND p.field = 'arguments')""")


def page_tokens(spark, sf):
    """Link texts and bold words play operands, bare leaves operators."""
    nodes = pages(spark, sf)
    kind = F.when(F.col("type").isin("a", "b", "p"), "identifier").otherwise(F.col("type"))
    return nodes.withColumn("type", kind).withColumn("text", F.md5("text"))


b.CTES["page_leaves"] = """
SELECT repository_id, file_path, CASE WHEN type IN ('a', 'b', 'p') THEN 'identifier' ELSE type END AS type, is_named, md5(text) AS text
FROM page_trees n WHERE NOT EXISTS (SELECT 1 FROM page_trees c WHERE c.file_path = n.file_path AND c.parent_id = n.node_id)"""


def _halstead_sql(leaves: str, files: str) -> str:
    operand = f"is_named AND type IN ({listed(trees.OPERAND_TYPES)})"
    operator = f"NOT is_named AND type NOT IN ({listed(trees.SKIPPED_LEAVES)})"
    return f"""
SELECT f.repository_id, f.file_path, count(DISTINCT type) FILTER ({operator}) AS distinct_operators,
       count(DISTINCT text) FILTER ({operand}) AS distinct_operands, count(*) FILTER ({operator}) AS operators,
       count(*) FILTER ({operand}) AS operands
FROM (SELECT DISTINCT repository_id, file_path FROM {files}) f LEFT JOIN {leaves} l USING (repository_id, file_path) GROUP BY 1, 2"""


add("tm22_halstead", lambda spark, sf: trees.halstead(page_tokens(spark, sf)), _halstead_sql("page_leaves", "page_trees"))
b.CTES["ast_leaves"] = """
SELECT repository_id, file_path, type, is_named, text FROM ast_nodes n
WHERE NOT EXISTS (SELECT 1 FROM ast_nodes c WHERE c.file_path = n.file_path AND c.parent_id = n.node_id)"""
add("tm22_halstead_code", lambda spark, sf: trees.halstead(b.ast_nodes(spark, sf)), _halstead_sql("ast_leaves", "ast_nodes"))
add("tm24_dip_candidates", lambda spark, sf: trees.dip_candidates(
    b.ast_nodes(spark, sf), constructors=["__init__", "constructor", "load_all"]).select("file_path", "title", "metadata"), """
SELECT f.file_path, '`' || f.function_name || '` directly instantiates concrete dependencies' AS title,
       '{"instantiated_types":["' || string_agg(n.text, '","' ORDER BY c.pre) || '"]}' AS metadata
FROM ast_functions f JOIN ast_nodes c ON c.file_path = f.file_path AND c.pre BETWEEN f.pre AND f.post
JOIN ast_nodes n ON n.file_path = c.file_path AND n.parent_id = c.node_id AND (
  (c.language = 'javascript' AND c.type = 'new_expression' AND n.field = 'constructor')
  OR (c.language = 'java' AND c.type = 'object_creation_expression' AND n.field = 'type')
  OR (c.language = 'python' AND c.type = 'call' AND n.field = 'function' AND n.type = 'identifier' AND regexp_matches(n.text, '^[A-Z]')))
WHERE f.function_name IN ('__init__', 'constructor', 'load_all') GROUP BY f.file_path, f.node_id, f.function_name""")
b.CTES["page_arms"] = """
SELECT f.*, count(*)::INTEGER AS arms FROM pf f JOIN page_trees n ON n.file_path = f.file_path AND n.pre BETWEEN f.pre AND f.post AND n.type = 'li'
GROUP BY ALL"""
add("tm25_branch_arms", lambda spark, sf: trees.ocp_candidates(trees.branch_arms(pages(spark, sf), HTML)).select(
    "file_path", "title", "evidence"), """
SELECT file_path, '`<anonymous>` has a ' || arms || '-way branch that may violate the Open/Closed Principle' AS title,
       arms || ' branch arms in one function' AS evidence FROM page_arms WHERE arms >= 4""")
add("tm25_branch_arms_code", lambda spark, sf: trees.ocp_candidates(trees.branch_arms(b.ast_nodes(spark, sf))).select(
    "file_path", "symbol_name", "evidence"), """
SELECT f.file_path, f.function_name AS symbol_name, count(*) || ' branch arms in one function' AS evidence
FROM ast_functions f JOIN ast_nodes n ON n.file_path = f.file_path AND n.pre BETWEEN f.pre AND f.post
  AND n.type IN ('elif_clause', 'switch_case', 'case_clause', 'switch_label')
GROUP BY f.file_path, f.node_id, f.function_name HAVING count(*) >= 4""")

# --- classes -------------------------------------------------------------------------------

b.CTES["class_sizes"] = """
SELECT c.*, c.end_line - c.start_line + 1 AS lines, (SELECT count(*) FROM class_symbols m WHERE m.parent_id = c.id AND m.kind = 'METHOD') AS methods
FROM class_symbols c WHERE c.kind = 'CLASS'"""
add("tm5_large_class", lambda spark, sf: trees.large_classes(trees.class_sizes(b.class_symbols(spark, sf))).select(
    "repository_id", "file_path", "severity", "title"), """
SELECT repository_id, file_path, CASE WHEN lines <= 500 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
       '`' || name || '` is a large class (' || lines || ' lines, ' || methods || ' methods)' AS title
FROM class_sizes WHERE lines > 300 OR methods > 15""")
add("tm23_srp_candidates", lambda spark, sf: trees.srp_candidates(trees.class_sizes(b.class_symbols(spark, sf))).select(
    "file_path", "title", "end_line"), """
SELECT file_path, '`' || name || '` may violate the Single Responsibility Principle' AS title, end_line FROM class_sizes
WHERE methods >= 10 AND lines >= 200""")


def stub_files(spark, sf):
    """One file per class path: 10 lines per method slot, some stubs, some comments."""
    slot = (
        "CASE i % 5 WHEN 0 THEN concat_ws(chr(10), '  def', '    pass', '', '', '', '', '', '  end') "
        "WHEN 1 THEN concat_ws(chr(10), '  m() {', '    // note', chr(9) || 'throw new FooError()', '', '', '', '', '  }') "
        "WHEN 2 THEN concat_ws(chr(10), '  m() {', '    a()', '    b()', '    raise NotImplementedError', '', '', '', '  }') "
        "WHEN 3 THEN concat_ws(chr(10), '  m() {', '    x = 1', '', '', '', '', '', '  }') "
        "ELSE concat_ws(chr(10), '  m() {', '    log()', '    raise  NotImplementedError', '', '', '', '', '  }') END")
    bodies = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.element_at(F.col("slots"), i + 1)), "\n\n\n")
    slots = F.array(*[F.expr(slot.replace("i %", f"{i} %")) for i in range(18)])
    return b.class_symbols(spark, sf).select("repository_id", F.col("file_path").alias("path")).distinct().withColumn(
        "slots", slots).withColumn("content", F.concat(F.lit("class\n"), bodies)).drop("slots")


b.CTES["trivial_syms"] = """
SELECT m.* FROM class_symbols m WHERE kind = 'METHOD' AND TRY_CAST(split_part(id, '_', 2) AS INTEGER) % 5 IN (0, 1, 4)"""
add("tm26_trivial_methods", lambda spark, sf: trees.trivial_methods(b.class_symbols(spark, sf), stub_files(spark, sf)).select("id"),
    "SELECT id FROM trivial_syms")
add("tm26_trivial_documents", lambda spark, sf: b.document_files(spark, sf).filter(trees.trivial_body(
    tx.text_lines(F.regexp_replace("content", r"(?m)^(Is|The|Of|And)\b", "pass")), F.lit(0), F.lit(4))).select("path"), """
SELECT path FROM (SELECT path, list_filter(list_transform(string_split(content, chr(10))[1:3],
    lambda l: regexp_replace(regexp_replace(l, '^(Is|The|Of|And)\\b', 'pass'), '^\\s+|\\s+$', '', 'g')),
    lambda l: l <> '' AND NOT regexp_matches(l, '^(//|#|\\*|/\\*)')) AS told FROM doc_files)
WHERE len(told) BETWEEN 1 AND 2 AND len(list_filter(told, lambda l: regexp_matches(l, '(?i)^(pass|\\.\\.\\.)'))) > 0""")


def trivial(spark, sf):
    return trees.trivial_methods(b.class_symbols(spark, sf), stub_files(spark, sf))


add("tm27_lsp_candidates", lambda spark, sf: trees.lsp_candidates(trivial(spark, sf), b.class_symbols(spark, sf)).select(
    "file_path", "symbol_name", "start_line"), """
SELECT m.file_path, c.name || '.' || m.name AS symbol_name, m.start_line FROM trivial_syms m JOIN class_symbols c ON c.id = m.parent_id
WHERE c.kind = 'CLASS' AND coalesce(c.superclasses, '') <> ''""")
add("tm28_isp_candidates", lambda spark, sf: trees.isp_candidates(trivial(spark, sf), b.class_symbols(spark, sf)).select(
    "file_path", "symbol_name", "evidence"), """
SELECT c.file_path, c.name AS symbol_name, count(*) || ' trivial/empty method implementations' AS evidence
FROM trivial_syms m JOIN class_symbols c ON c.id = m.parent_id WHERE c.kind = 'CLASS' AND coalesce(c.interfaces, '') <> ''
GROUP BY c.id, c.file_path, c.name HAVING count(*) >= 2""")
add("tm29_pattern_candidates", lambda spark, sf: patterns.pattern_candidates(b.class_symbols(spark, sf)).select(
    "file_path", "type", "confidence", "title"), f"""
WITH m AS (SELECT parent_id, bool_or(regexp_matches(name, {quoted(patterns.INSTANCE_METHOD)})) AS inst,
    bool_or(regexp_matches(name, {quoted(patterns.FACTORY_METHOD)})) AS fac,
    count(*) FILTER (regexp_matches(name, {quoted(patterns.CRUD_METHOD)})) AS crud,
    bool_or(regexp_matches(name, {quoted(patterns.SUBSCRIBE_METHOD)})) AS sub,
    bool_or(regexp_matches(name, {quoted(patterns.NOTIFY_METHOD)})) AS noti, bool_or(lower(name) = 'build') AS bld
  FROM class_symbols WHERE kind = 'METHOD' GROUP BY 1),
c AS (SELECT * FROM class_symbols LEFT JOIN m ON m.parent_id = id WHERE kind = 'CLASS'),
hits AS (
  SELECT *, 'SINGLETON' AS type, 45 AS confidence FROM c WHERE inst
  UNION ALL SELECT *, 'FACTORY', 45 FROM c WHERE fac OR regexp_matches(name, '(?i)factory$')
  UNION ALL SELECT *, 'REPOSITORY', 45 FROM c WHERE crud >= 2 AND regexp_matches(name, '(?i)(repository|repo)$')
  UNION ALL SELECT *, 'OBSERVER', 45 FROM c WHERE sub AND noti
  UNION ALL SELECT *, 'BUILDER', 45 FROM c WHERE bld AND regexp_matches(name, '(?i)builder$')
  UNION ALL SELECT *, 'ADAPTER', 30 FROM c WHERE regexp_matches(name, '(?i)adapter$')
  UNION ALL SELECT *, 'DECORATOR', 30 FROM c WHERE regexp_matches(name, '(?i)decorator$')
  UNION ALL SELECT *, 'FACADE', 30 FROM c WHERE regexp_matches(name, '(?i)facade$'))
SELECT file_path, type, confidence, '`' || name || '` looks like a ' || upper(left(type, 1)) || lower(substr(type, 2)) || ' pattern' AS title
FROM hits""")
b.CTES["bases"] = """
SELECT repository_id, id, name, file_path, trim(base, ' ') AS base FROM (
  SELECT *, unnest(list_concat(string_split(coalesce(interfaces, ''), ','), string_split(coalesce(superclasses, ''), ','))) AS base
  FROM class_symbols WHERE kind = 'CLASS') WHERE trim(base, ' ') <> '' AND lower(trim(base, ' ')) NOT IN ('object', 'exception', 'error', 'component')"""
b.CTES["families"] = """
SELECT s.repository_id, s.base, s.siblings, string_agg(x.name, ',' ORDER BY x.name) AS shared_methods
FROM (SELECT repository_id, base, count(*) AS siblings, count(DISTINCT id) AS classes FROM bases GROUP BY 1, 2) s
JOIN (SELECT b.repository_id, b.base, m.name, count(DISTINCT b.id) AS n FROM bases b JOIN class_symbols m ON m.parent_id = b.id
      WHERE m.kind = 'METHOD' GROUP BY ALL) x ON x.repository_id = s.repository_id AND x.base = s.base AND x.n = s.classes
WHERE siblings >= 2 GROUP BY ALL"""
add("tm30_strategy_families", lambda spark, sf: patterns.strategy_families(b.class_symbols(spark, sf)).withColumn(
    "shared_methods", F.array_join("shared_methods", ",")), "SELECT * FROM families")
add("tm30_strategy_candidates", lambda spark, sf: patterns.strategy_candidates(b.class_symbols(spark, sf)).select(
    "file_path", "title"), """
SELECT b.file_path, '`' || b.name || '` looks like a Strategy pattern' AS title FROM bases b JOIN families USING (repository_id, base)""")


def supplier_classes(spark, sf):
    """Suppliers as classes of one base per brand, the sizes they ship as methods."""
    lines = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = lines.select("l_suppkey", "p_brand", (F.col("p_size") % 3).alias("size")).distinct()
    classes = pairs.select("l_suppkey", "p_brand").distinct().select(
        F.lit("r").alias("repository_id"), F.lit("f").alias("file_path"), F.concat_ws("-", "l_suppkey", "p_brand").alias("id"),
        F.lit(None).cast("string").alias("parent_id"), F.lit("CLASS").alias("kind"), F.concat(F.lit("S"), "l_suppkey").alias("name"),
        F.col("p_brand").alias("superclasses"))
    methods = pairs.select(
        F.lit("r").alias("repository_id"), F.lit("f").alias("file_path"), F.concat_ws("-", "l_suppkey", "p_brand", "size").alias("id"),
        F.concat_ws("-", "l_suppkey", "p_brand").alias("parent_id"), F.lit("METHOD").alias("kind"),
        F.concat(F.lit("m"), "size").alias("name"), F.lit(None).cast("string").alias("superclasses"))
    return classes.unionByName(methods).withColumns({
        "interfaces": F.lit(None).cast("string"), "start_line": F.lit(1), "end_line": F.lit(2)})


add("tm30_suppliers_sharing_a_part", lambda spark, sf: patterns.strategy_families(supplier_classes(spark, sf)).select(
    "base", "siblings", F.array_join("shared_methods", ",").alias("shared_methods")), """
WITH pairs AS (SELECT DISTINCT l_suppkey, p_brand, p_size % 3 AS size FROM lineitem JOIN part ON p_partkey = l_partkey),
sizes AS (SELECT p_brand, count(DISTINCT l_suppkey) AS siblings FROM pairs GROUP BY 1),
shared AS (SELECT p_brand, 'm' || size AS m FROM pairs JOIN sizes USING (p_brand) GROUP BY p_brand, size, siblings HAVING count(*) = siblings)
SELECT p_brand AS base, siblings, string_agg(m, ',' ORDER BY m) AS shared_methods FROM shared JOIN sizes USING (p_brand)
WHERE siblings >= 2 GROUP BY ALL""")

# --- scores read from trees and graphs --------------------------------------------------------


def sample_files(spark, sf):
    return b.ast_files(spark, sf).withColumn("lines_of_code", tx.count_lines(F.col("content")))


b.CTES["file_index"] = f"""
WITH h AS ({_halstead_sql("ast_leaves", "ast_nodes")}),
loc AS (SELECT repository_id, path AS file_path, len(string_split(rtrim(content, chr(10)), chr(10))) AS n FROM ast_files),
cx AS (SELECT file_path, avg(complexity) AS c FROM ast_cx GROUP BY 1)
SELECT repository_id, file_path, round_even(greatest(0.0, least(100.0, (171
    - 5.2 * ln(greatest((operators + operands) * log2(greatest(distinct_operators + distinct_operands, 2)), 1.0))
    - 0.23 * coalesce(c, 1.0) - 16.2 * ln(greatest(n, 1))) * 100 / 171)), 0)::INTEGER AS maintainability
FROM h JOIN loc USING (repository_id, file_path) LEFT JOIN cx USING (file_path)"""
def maintained(spark, sf):
    ast = b.ast_nodes(spark, sf)
    return scores.maintainability(trees.halstead(ast), trees.complexity(ast), sample_files(spark, sf))


add("sc3_maintainability", maintained, """
SELECT repository_id, round_even(avg(maintainability), 0)::INTEGER AS maintainability_score FROM file_index GROUP BY 1""")


def customer_files(spark, sf):
    return b.table(spark, sf, "customer").select(
        F.expr(b.repository_of("c_custkey")).alias("repository_id"), F.col("c_custkey").cast("string").alias("path"))


add("sc4_modularity", lambda spark, sf: scores.modularity(b.graph_edges(spark, sf), customer_files(spark, sf)), """
SELECT repository_id, greatest(0, least(100, round_even(100 - (SELECT count(*) FROM (SELECT repository_id AS r, unnest([src, dst]) AS p FROM graph)
  WHERE r = f.repository_id AND p IN (SELECT c_custkey::VARCHAR FROM customer)) / f.n * 4, 0)))::INTEGER AS modularity_score
FROM (SELECT 'r' || (c_custkey // 10 % 7) AS repository_id, count(*) AS n FROM customer GROUP BY 1) f""")
add("sc5_documentation", lambda spark, sf: scores.documentation(b.class_symbols(spark, sf)), """
SELECT repository_id, round_even(count(doc_comment) / count(*) * 100, 0)::INTEGER AS documentation_score FROM class_symbols GROUP BY 1""")
add("sc6_complexity_score", lambda spark, sf: scores.complexity_score(trees.complexity(pages(spark, sf), HTML)), """
SELECT repository_id, greatest(0, least(100, round_even(100 - avg(complexity) * 5, 0)))::INTEGER AS complexity_score FROM page_cx GROUP BY 1""")


def health(spark, sf):
    """Findings of each user filed under a brand, with that brand's sample trees."""
    brand = F.concat(F.lit("Brand#"), F.substring("repository_id", 2, 9).cast("int") % 25 + 1)
    found = b.findings(spark, sf).withColumn("repository_id", brand)
    files = sample_files(spark, sf)
    ast = b.ast_nodes(spark, sf)
    measured = trees.complexity(ast)
    empty = b.graph_edges(spark, sf)
    return scores.health_scores(
        found, files, scores.maintainability(trees.halstead(ast), measured, files),
        scores.modularity(empty, files), scores.documentation(b.class_symbols(spark, sf)), scores.complexity_score(measured))


add("sc8_health_scores", health, """
WITH files AS (SELECT repository_id, count(*) AS n FROM ast_files GROUP BY 1),
f AS (SELECT 'Brand#' || (substr(repository_id, 2)::INTEGER % 25 + 1) AS repository_id, category, type, penalty
      FROM fnd JOIN ranked_severity USING (severity)),
p AS (SELECT repository_id, sum(penalty) AS penalty,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'DEPENDENCY'), 0))::INTEGER AS architecture_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'SECURITY'), 0))::INTEGER AS security_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (category = 'PERFORMANCE'), 0))::INTEGER AS performance_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (type IN ('BLOCKING_OPERATION', 'N_PLUS_ONE_QUERY', 'HEAVY_DATABASE_CALL',
    'MISSING_CACHING')), 0))::INTEGER AS scalability_score,
  greatest(0, 100 - coalesce(sum(penalty) FILTER (type = 'LAYER_VIOLATION'), 0))::INTEGER AS layering_score FROM f GROUP BY 1),
m AS (SELECT repository_id, round_even(avg(maintainability), 0)::INTEGER AS maintainability_score FROM file_index GROUP BY 1),
d AS (SELECT repository_id, round_even(count(doc_comment) / count(*) * 100, 0)::INTEGER AS documentation_score FROM class_symbols GROUP BY 1),
c AS (SELECT repository_id, greatest(0, least(100, round_even(100 - avg(complexity) * 5, 0)))::INTEGER AS complexity_score FROM ast_cx GROUP BY 1),
j AS (SELECT files.repository_id, coalesce(architecture_score, 100) AS architecture_score, coalesce(security_score, 100) AS security_score,
  coalesce(performance_score, 100) AS performance_score, maintainability_score, coalesce(scalability_score, 100) AS scalability_score,
  100 AS modularity_score, coalesce(layering_score, 100) AS layering_score, documentation_score, complexity_score,
  greatest(0, least(100, round_even(100 - coalesce(penalty, 0) / n * 10, 0)))::INTEGER AS technical_debt_score
  FROM files LEFT JOIN p USING (repository_id) LEFT JOIN m USING (repository_id) LEFT JOIN d USING (repository_id) LEFT JOIN c USING (repository_id))
SELECT *, round_even((architecture_score + security_score + performance_score + maintainability_score + documentation_score
  + complexity_score + technical_debt_score) / 7, 0)::INTEGER AS overall_score FROM j""")
