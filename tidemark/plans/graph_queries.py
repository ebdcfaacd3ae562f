"""Graphs, layers, dependents and packages over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import graphs, imports as im, packages as pk
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, quoted

# --- imports ---------------------------------------------------------------------------

IMPORT_MODULE = (
    "CASE p_partkey % 4 "
    "WHEN 0 THEN CASE p_size % 4 WHEN 0 THEN '.f' || n WHEN 1 THEN '..models.f' || n WHEN 2 THEN 'src.routes.f' || n ELSE 'os.path' END "
    "WHEN 3 THEN CASE p_size % 3 WHEN 0 THEN 'src.db.f' || n WHEN 1 THEN 'f' || n ELSE 'java.util' END "
    "ELSE CASE p_size % 5 WHEN 0 THEN './f' || n WHEN 1 THEN '../db/./f' || n WHEN 2 THEN '../api/x/../f' || n || '.js' "
    "WHEN 3 THEN '../../src/util/f' || n ELSE 'react' END END")


def code_imports(spark, sf):
    """Two imports per part file, aimed at files of the same brand and others."""
    part = b.table(spark, sf, "part").withColumn("n", F.explode(F.expr("array((p_partkey * 7) % 200, (p_partkey + 4) % 2000)")))
    return part.select(
        F.lit("all").alias("repository_id"), F.expr(b.CODE_PATH).alias("file_path"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' ELSE 'java' END").alias("language"),
        F.expr(IMPORT_MODULE).alias("module"))


def one_repository(spark, sf):
    return b.code_files(spark, sf).select(F.lit("all").alias("repository_id"), "path", "language")


b.CTES["code_imports"] = f"""
SELECT {b.CODE_PATH} AS file_path, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' ELSE 'java' END AS language,
       p_size, {b.CODE_FOLDER} AS folder, n, {IMPORT_MODULE} AS module
FROM (SELECT *, unnest([(p_partkey * 7) % 200, (p_partkey + 4) % 2000]) AS n FROM part)"""
# Where each module points, worked out by shape rather than by path arithmetic.
b.CTES["import_targets"] = """
SELECT i.*, coalesce(
  (SELECT c.path FROM code_files c JOIN (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts']) AS e, unnest(range(0, 8)) AS o) x
     ON c.path = i.stem || x.e WHERE i.language IN ('javascript', 'typescript') AND i.stem IS NOT NULL ORDER BY x.o LIMIT 1),
  (SELECT c.path FROM code_files c WHERE i.language = 'python' AND c.path = i.stem || '.py'),
  (SELECT min(c.path) FROM code_files c WHERE i.language = 'java' AND (c.path = i.stem || '.java' OR ends_with(c.path, '/' || i.stem || '.java'))))
  AS target_path
FROM (SELECT *, CASE language
    WHEN 'python' THEN CASE p_size % 4 WHEN 0 THEN 'src/' || folder || '/f' || n WHEN 1 THEN 'src/models/f' || n WHEN 2 THEN 'src/routes/f' || n ELSE 'os/path' END
    WHEN 'java' THEN CASE p_size % 3 WHEN 0 THEN 'src/db/f' || n WHEN 1 THEN 'f' || n ELSE 'java/util' END
    ELSE CASE p_size % 5 WHEN 0 THEN 'src/' || folder || '/f' || n WHEN 1 THEN 'src/db/f' || n WHEN 2 THEN 'src/api/f' || n || '.js'
         WHEN 3 THEN 'src/util/f' || n END END AS stem FROM code_imports) i"""
add("ix6_resolve_imports", lambda spark, sf: im.resolve_imports(code_imports(spark, sf), one_repository(spark, sf)).select(
    "file_path", "module", "target_path"), "SELECT file_path, module, target_path FROM import_targets")
add("ix4_import_edges", lambda spark, sf: im.import_edges(code_imports(spark, sf), one_repository(spark, sf)), """
SELECT 'all' AS repository_id, file_path AS source_file_path, module AS target_package_name, target_path AS target_file_path,
       'IMPORTS' AS edge_type FROM import_targets""")
add("gr1_file_graph", lambda spark, sf: graphs.file_graph(code_imports(spark, sf), one_repository(spark, sf)), """
SELECT DISTINCT 'all' AS repository_id, file_path AS src, target_path AS dst FROM import_targets
WHERE target_path IS NOT NULL AND target_path <> file_path""")

# --- cycles, depth, coupling --------------------------------------------------------------

b.CTES["reach"] = """
WITH RECURSIVE r AS (SELECT src, dst FROM graph UNION SELECT r.src, g.dst FROM r JOIN graph g ON g.src = r.dst) SELECT * FROM r"""
b.CTES["strong"] = """
SELECT a.src AS node, least(a.src, min(a.dst)) AS grp FROM reach a JOIN reach z ON z.src = a.dst AND z.dst = a.src
WHERE a.src <> a.dst GROUP BY a.src"""
add("gr2_strong_groups", lambda spark, sf: graphs.strong_groups(b.graph_edges(spark, sf)).select(
    "node", F.col("group").alias("grp")), "SELECT node, grp FROM strong")


def _cycles(spark, sf):
    return graphs.cycles(b.graph_edges(spark, sf))


b.CTES["chains"] = """
WITH RECURSIVE inside AS (SELECT g.src, g.dst, a.grp FROM graph g JOIN strong a ON a.node = g.src JOIN strong z ON z.node = g.dst AND z.grp = a.grp),
walk AS (SELECT grp, grp AS node, [grp] AS path, FALSE AS closed FROM (SELECT DISTINCT grp FROM strong)
  UNION ALL
  SELECT w.grp, i.dst, list_append(w.path, i.dst), i.dst = w.grp FROM walk w JOIN inside i ON i.grp = w.grp AND i.src = w.node
  WHERE NOT w.closed AND (i.dst = w.grp OR NOT list_contains(w.path, i.dst)))
SELECT grp, path AS chain FROM walk WHERE closed
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY len(path), path) = 1"""
add("gr2_cycles", lambda spark, sf: _cycles(spark, sf).select(
    F.col("group").alias("grp"), "members", F.array_join("chain", ",").alias("chain")), """
SELECT grp, (SELECT count(*) FROM strong s WHERE s.grp = c.grp) AS members, array_to_string(chain, ',') AS chain FROM chains c""")
add("gr2_cycle_findings", lambda spark, sf: graphs.cycle_findings(_cycles(spark, sf)).select("file_path", "title", "confidence"), """
SELECT grp AS file_path, 'Circular dependency: ' || array_to_string(chain[1:len(chain) - 1], ' -> ') AS title, 95 AS confidence FROM chains""")


def _file_cycles(spark, sf):
    return graphs.file_cycles(b.graph_edges(spark, sf))


b.CTES["group_edges"] = """
SELECT g.src, g.dst, a.grp FROM graph g JOIN strong a ON a.node = g.src JOIN strong z ON z.node = g.dst AND z.grp = a.grp"""
# Steps from file to file inside a group; the shared graph has at most ten files in one.
b.CTES["group_steps"] = """
WITH RECURSIVE r AS (SELECT src AS start, dst AS node, 1 AS d FROM group_edges
  UNION SELECT r.start, e.dst, r.d + 1 FROM r JOIN group_edges e ON e.src = r.node WHERE r.d < 10)
SELECT start, node, min(d) AS d FROM r GROUP BY 1, 2"""
b.CTES["file_chains"] = """
WITH RECURSIVE w AS (SELECT DISTINCT grp, src AS start, src AS node, [src] AS path, FALSE AS closed FROM group_edges
  UNION ALL
  SELECT w.grp, w.start, e.dst, list_append(w.path, e.dst), e.dst = w.start FROM w JOIN group_edges e ON e.src = w.node
  JOIN group_steps s ON s.start = w.start AND s.node = e.dst AND s.d = len(w.path) WHERE NOT w.closed),
best AS (SELECT grp, path[1:len(path) - 1] AS p FROM w WHERE closed QUALIFY row_number() OVER (PARTITION BY start ORDER BY path) = 1),
turned AS (SELECT grp, list_sort(p) AS files, list_concat(p[list_position(p, list_min(p)):], p[1:list_position(p, list_min(p)) - 1]) AS chain FROM best)
SELECT grp, chain FROM turned QUALIFY row_number() OVER (PARTITION BY files ORDER BY chain) = 1"""
add("gr2_file_cycles", lambda spark, sf: _file_cycles(spark, sf).select(
    F.col("group").alias("grp"), "length", F.array_join("chain", ",").alias("chain")), """
SELECT grp, len(chain)::INTEGER AS length, array_to_string(chain, ',') || ',' || chain[1] AS chain FROM file_chains""")
add("gr2_file_cycle_findings", lambda spark, sf: graphs.cycle_findings(_file_cycles(spark, sf)).select("file_path", "title", "severity"), """
SELECT chain[1] AS file_path, 'Circular dependency: ' || array_to_string(chain, ' -> ') AS title, 'MEDIUM' AS severity FROM file_chains""")
add("ro15_cycle_edges", lambda spark, sf: graphs.cycle_edges(_cycles(spark, sf)).select(
    F.col("group").alias("grp"), "position", "src", "dst"), """
SELECT grp, (i - 1)::INTEGER AS position, chain[i] AS src, chain[i + 1] AS dst FROM (SELECT grp, chain, unnest(range(1, len(chain))) AS i FROM chains)""")


def customer_files(spark, sf):
    return b.table(spark, sf, "customer").select(
        F.expr(b.repository_of("c_custkey")).alias("repository_id"), F.col("c_custkey").cast("string").alias("path"))


b.CTES["degrees"] = """
SELECT c_custkey::VARCHAR AS path, (SELECT count(*) FROM graph WHERE src = c_custkey::VARCHAR) AS efferent,
       (SELECT count(*) FROM graph WHERE dst = c_custkey::VARCHAR) AS afferent FROM customer"""
add("gr3_coupling", lambda spark, sf: graphs.coupling(b.graph_edges(spark, sf), customer_files(spark, sf)).drop("repository_id"),
    "SELECT * FROM degrees")
add("gr3_high_coupling", lambda spark, sf: graphs.high_coupling(
    graphs.coupling(b.graph_edges(spark, sf), customer_files(spark, sf)), 2).select("title", "file_path"), """
SELECT path || ' has high coupling (' || efferent || ' outgoing, ' || afferent || ' incoming)' AS title, path AS file_path
FROM degrees WHERE efferent > 2 OR afferent > 2""")
b.CTES["depths"] = """
WITH RECURSIVE d AS (
  SELECT DISTINCT dst AS node, 1 AS depth FROM dag WHERE dst NOT IN (SELECT src FROM dag)
  UNION SELECT g.src, d.depth + 1 FROM d JOIN dag g ON g.dst = d.node)
SELECT node AS path, max(depth)::BIGINT AS depth FROM d GROUP BY 1"""
add("gr4_dependency_depth", lambda spark, sf: graphs.dependency_depth(b.dag_edges(spark, sf)).drop("repository_id"), "SELECT * FROM depths")
add("gr4_deep_chains", lambda spark, sf: graphs.deep_chains(graphs.dependency_depth(b.dag_edges(spark, sf)), 3).select("title", "file_path"), """
SELECT 'Deep dependency chain starting at ' || path || ' (' || depth || ' levels)' AS title, path AS file_path FROM depths
WHERE depth > 3 ORDER BY depth DESC, path LIMIT 1""")
add("gr4_depth_through_cycles", lambda spark, sf: graphs.deep_chains(graphs.dependency_depth(b.graph_edges(spark, sf)), 1).select("file_path", "title"), """
WITH RECURSIVE comp AS (SELECT n.node, coalesce(s.grp, n.node) AS grp FROM (SELECT src AS node FROM graph UNION SELECT dst FROM graph) n
  LEFT JOIN strong s ON s.node = n.node),
sizes AS (SELECT grp, count(*) AS size FROM comp GROUP BY 1),
e AS (SELECT DISTINCT a.grp AS src, z.grp AS dst FROM graph g JOIN comp a ON a.node = g.src JOIN comp z ON z.node = g.dst WHERE a.grp <> z.grp),
d AS (SELECT grp, size AS depth FROM sizes UNION SELECT e.src, d.depth + s.size FROM d JOIN e ON e.dst = d.grp JOIN sizes s ON s.grp = e.src)
SELECT c.node AS file_path, 'Deep dependency chain starting at ' || c.node || ' (' || max(d.depth) || ' levels)' AS title
FROM comp c JOIN d ON d.grp = c.grp GROUP BY c.node HAVING max(d.depth) > 1
QUALIFY row_number() OVER (PARTITION BY c.node::BIGINT // 10 % 7 ORDER BY max(d.depth) DESC, c.node) = 1""")

# --- layers -----------------------------------------------------------------------------------

LAYER_PATH = (
    "CASE p_partkey % 9 WHEN 0 THEN 'src/Routes/x.ts' WHEN 1 THEN 'app/service/y.py' WHEN 2 THEN 'lib/user_repo.py' WHEN 3 THEN 'lib/user.model.ts' "
    "WHEN 4 THEN 'db.go' WHEN 5 THEN 'lib/database/routes/z.ts' WHEN 6 THEN 'lib/plain.ts' WHEN 7 THEN 'lib/myservice.ts' ELSE 'storage' END")
add("gr5_layer_rank", lambda spark, sf: b.table(spark, sf, "part").select("p_partkey", F.expr(LAYER_PATH).alias("path")).select(
    "p_partkey", paths.layer_rank(F.col("path")).alias("layer")), """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 8 THEN 4 END AS layer FROM part""")
add("gr5_code_folders", lambda spark, sf: b.code_files(spark, sf).select("path", paths.layer_rank(F.col("path")).alias("layer")), """
SELECT path, CASE split_part(path, '/', 2) WHEN 'routes' THEN 1 WHEN 'api' THEN 1 WHEN 'services' THEN 2 WHEN 'models' THEN 3
  WHEN 'infra' THEN 4 WHEN 'db' THEN 4 END AS layer FROM code_files""")


def layered_edges(spark, sf):
    """Graph nodes as files in a folder named after their customer's region."""
    nations = b.table(spark, sf, "nation")
    folder = F.expr("CASE n_regionkey WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'models' WHEN 3 THEN 'infra' ELSE 'lib' END")
    homes = b.table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("k"), F.concat(folder, F.lit("/"), F.col("c_custkey").cast("string")).alias("p"))
    edges = b.graph_edges(spark, sf)
    for end in ("src", "dst"):
        edges = edges.join(homes.select(F.col("k").alias(end), F.col("p").alias(f"_{end}")), end)
    return edges.select("repository_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"))


add("gr6_layer_violations", lambda spark, sf: graphs.layer_violations(layered_edges(spark, sf)).select("title", "evidence"), f"""
WITH homes AS (SELECT c_custkey::VARCHAR AS k, n_regionkey + 1 AS rank, (['routes', 'services', 'models', 'infra', 'lib'])[n_regionkey + 1] || '/' || c_custkey AS p,
  ([{", ".join(quoted(paths.LAYER_NAMES[i]) for i in (1, 2, 3, 4))}])[n_regionkey + 1] AS layer FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT s.p || ' (' || s.layer || ') depends on ' || t.p || ' (' || t.layer || ')' AS title, s.p || ' -> ' || t.p AS evidence
FROM graph JOIN homes s ON s.k = src JOIN homes t ON t.k = dst WHERE s.rank <= 4 AND t.rank <= 4 AND t.rank < s.rank""")

# --- packages ---------------------------------------------------------------------------------

NPM_TEXT = (
    "CASE WHEN p_partkey % 13 = 0 THEN '{\"dependencies\": {\"broken\"' ELSE '{\"name\":\"x\",\"dependencies\":{\"lib' || p_size || '\":\"^1.' || (p_partkey % 7) || "
    "'.0\",\"any\":\"*\",\"none\":\">= \"},\"devDependencies\":{\"tool' || (p_size % 5) || '\":\"~' || (p_partkey % 3) || '.2\"}}' END")
PYPI_TEXT = (
    "concat_ws(chr(10), '# pins', 'lib' || p_size || '==1.' || (p_partkey % 7), '  tool == 2.' || (p_partkey % 3) || ' ; extra', 'range>=1.0', '', 'bare')")
MAVEN_TEXT = (
    "'<project><dependency><groupId>g' || p_size || '</groupId><artifactId>a</artifactId><version>' || CASE WHEN p_partkey % 4 = 0 THEN '${v}' "
    "ELSE '1.' || (p_partkey % 7) END || '</version></dependency>' || chr(10) || '<dependency><groupId>h</groupId><artifactId>b' || (p_partkey % 3) || "
    "'</artifactId></dependency></project>'")


def manifests(spark, sf):
    part = b.table(spark, sf, "part")
    rows = [
        part.select(F.concat(F.lit("r"), "p_partkey").alias("repository_id"), F.lit(name).alias("path"), F.expr(text).alias("content"))
        for name, text in (("package.json", NPM_TEXT), ("requirements.txt", PYPI_TEXT), ("pom.xml", MAVEN_TEXT), ("sub/pom.xml", MAVEN_TEXT))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


add("src6_root_manifests", lambda spark, sf: pk.select_manifests(manifests(spark, sf)).select("repository_id", "path"), """
SELECT 'r' || p_partkey AS repository_id, unnest(['package.json', 'requirements.txt', 'pom.xml']) AS path FROM part""")
b.CTES["npm_pk"] = """
SELECT 'r' || p_partkey AS repository_id, 'lib' || p_size AS name, '1.' || (p_partkey % 7) || '.0' AS version FROM part WHERE p_partkey % 13 <> 0
UNION ALL SELECT 'r' || p_partkey, 'any', '*' FROM part WHERE p_partkey % 13 <> 0
UNION ALL SELECT 'r' || p_partkey, 'tool' || (p_size % 5), (p_partkey % 3) || '.2' FROM part WHERE p_partkey % 13 <> 0"""
add("gr7_npm_packages", lambda spark, sf: pk.npm_packages(pk.select_manifests(manifests(spark, sf))).select("repository_id", "name", "version"),
    "SELECT * FROM npm_pk")
add("gr7_event_properties", lambda spark, sf: pk.npm_packages(b.table(spark, sf, "events").select(
    F.concat(F.lit("e"), "event_id").alias("repository_id"), F.lit("package.json").alias("path"),
    F.concat(F.lit('{"dependencies":'), "props", F.lit("}")).alias("content")), True).select("repository_id", "name", "version"), """
SELECT 'e' || event_id AS repository_id, 'k' AS name, props->>'$.k' AS version FROM events WHERE (props->>'$.k') IS NOT NULL""")
b.CTES["pypi_pk"] = """
SELECT 'r' || p_partkey AS repository_id, 'lib' || p_size AS name, '1.' || (p_partkey % 7) AS version FROM part
UNION ALL SELECT 'r' || p_partkey, 'tool', '2.' || (p_partkey % 3) FROM part"""
add("gr8_pypi_packages", lambda spark, sf: pk.pypi_packages(manifests(spark, sf)).select("repository_id", "name", "version"), "SELECT * FROM pypi_pk")
add("gr9_maven_packages", lambda spark, sf: pk.maven_packages(pk.select_manifests(manifests(spark, sf))).select("repository_id", "name", "version"), """
SELECT 'r' || p_partkey AS repository_id, 'g' || p_size || ':a' AS name, '1.' || (p_partkey % 7) AS version FROM part WHERE p_partkey % 4 <> 0""")


def shipped_packages(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey") % 50).alias("repository_id"), F.lit("package.json").alias("path"), F.col("l_linenumber").alias("position"),
        F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_linenumber").cast("string").alias("version"), F.lit("npm").alias("ecosystem"))


def part_advisories(spark, sf):
    part = b.table(spark, sf, "part").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)))
    return part.select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "p_partkey").alias("name"),
        F.expr("CASE n WHEN 0 THEN array('1', '3') ELSE array(CAST(n AS string)) END").alias("versions"),
        F.concat_ws("-", F.lit("ADV"), "p_partkey", "n").alias("id"), F.lit("s").alias("summary"),
        F.expr("CASE (p_size + n) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'low' END").alias("severity"),
        F.col("n").alias("position"))


b.CTES["adv"] = """
SELECT 'p' || p_partkey AS name, v AS version, n, 'ADV-' || p_partkey || '-' || n AS id,
       CASE (p_size + n) % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity
FROM (SELECT *, unnest(CASE n WHEN 0 THEN ['1', '3'] ELSE [n::VARCHAR] END) AS v FROM (SELECT *, unnest(range(0, p_size % 3 + 1)) AS n FROM part))"""
b.CTES["adv_top"] = """
SELECT name, version, arg_min(severity, n) AS severity, count(*) AS n, string_agg(id, '","' ORDER BY n) AS ids FROM adv GROUP BY 1, 2"""
add("gr10_unsafe_dependencies", lambda spark, sf: pk.unsafe_dependencies(shipped_packages(spark, sf), part_advisories(spark, sf)).select(
    "repository_id", "severity", "title", "metadata"), """
SELECT 'r' || (l_orderkey % 50) AS repository_id, a.severity, a.name || '@' || a.version || ' has ' || a.n || ' known vulnerabilit'
  || CASE WHEN a.n = 1 THEN 'y' ELSE 'ies' END AS title,
  '{"package":"' || a.name || '","version":"' || a.version || '","vuln_ids":["' || a.ids || '"]}' AS metadata
FROM lineitem JOIN adv_top a ON a.name = 'p' || l_partkey AND a.version = l_linenumber::VARCHAR""")


def diff_packages(spark, sf):
    """Base and head versions of each part's manifest; base names repeat."""
    part = b.table(spark, sf, "part")
    base = "'{\"dependencies\":{\"p' || p_partkey || '\":\"^1\",\"q\":\"2.' || (p_size % 3) || '\"},\"devDependencies\":{\"q\":\"2.' || (p_size % 2) || '\"}}'"
    head = "'{\"dependencies\":{\"p' || p_partkey || '\":\"~' || (p_partkey % 4) || '\",\"q\":\"2.1\",\"new\":\"latest\"},\"devDependencies\":{\"z' || p_size || '\":\"9\"}}'"
    rows = [part.select(F.concat(F.lit("r"), "p_partkey").alias("repository_id"), F.lit("package.json").alias("path"), F.expr(t).alias("content"))
            for t in (base, head)]
    return [pk.npm_packages(m, leading_digit=True) for m in rows]


add("gr11_dependency_diff", lambda spark, sf: pk.dependency_diff(*diff_packages(spark, sf), part_advisories(spark, sf)).select(
    "repository_id", "name", "version", "previous_version", F.array_join("vuln_ids", ",").alias("vuln_ids")), """
WITH head AS (
  SELECT 'r' || p_partkey AS repository_id, 'p' || p_partkey AS name, (p_partkey % 4)::VARCHAR AS version, '1' AS previous_version FROM part
  UNION ALL SELECT 'r' || p_partkey, 'q', '2.1', '2.' || (p_size % 2) FROM part
  UNION ALL SELECT 'r' || p_partkey, 'z' || p_size, '9', NULL FROM part)
SELECT h.repository_id, h.name, h.version, previous_version, coalesce((SELECT string_agg(id, ',' ORDER BY n) FROM adv a
  WHERE a.name = h.name AND a.version = h.version), '') AS vuln_ids
FROM head h WHERE h.version IS DISTINCT FROM previous_version""")

# --- dependents -------------------------------------------------------------------------------


def graph_symbols(spark, sf):
    """One symbol per customer, in a file of ten customers."""
    return b.table(spark, sf, "customer").select(
        F.expr(b.repository_of("c_custkey")).alias("repository_id"), F.concat(F.lit("s"), "c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("f"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("file_path"), F.col("c_mktsegment").alias("kind"))


def typed_edges(spark, sf):
    """Edges that name a target file (even targets), else a target symbol, else a package."""
    dst = F.col("dst").cast("bigint")
    return b.graph_edges(spark, sf).select(
        "repository_id", F.concat(F.lit("s"), "src").alias("source_symbol_id"),
        F.when(dst % 3 == 1, F.concat(F.lit("s"), "dst")).alias("target_symbol_id"),
        F.when(dst % 3 == 2, F.concat(F.lit("pkg"), "dst")).alias("target_package_name"),
        F.when(dst % 3 == 0, F.concat(F.lit("f"), F.floor(dst / 10).cast("string"))).alias("target_file_path"),
        F.when(dst % 2 == 0, "IMPORTS").otherwise("EXTENDS").alias("edge_type"))


b.CTES["typed"] = """
SELECT repository_id, 's' || src AS source_symbol_id, CASE WHEN dst::BIGINT % 3 = 1 THEN 's' || dst END AS target_symbol_id,
       CASE WHEN dst::BIGINT % 3 = 2 THEN 'pkg' || dst END AS target_package_name,
       CASE WHEN dst::BIGINT % 2 = 0 THEN 'IMPORTS' ELSE 'EXTENDS' END AS edge_type,
       CASE WHEN dst::BIGINT % 3 < 2 THEN 'f' || (dst::BIGINT // 10) END AS changed_file_path, c.c_name AS dependent_symbol_name,
       'f' || (c.c_custkey // 10) AS dependent_file_path, c.c_mktsegment AS source_kind, t.c_name AS target_name
FROM graph JOIN customer c ON c.c_custkey::VARCHAR = src LEFT JOIN customer t ON t.c_custkey::VARCHAR = dst AND dst::BIGINT % 3 = 1"""


def changed_paths(spark, sf):
    return graph_symbols(spark, sf).select("repository_id", F.col("file_path").alias("path")).distinct().filter(
        "CAST(substring(path, 2) AS int) % 4 = 1")


add("gr12_dependents", lambda spark, sf: graphs.dependents(typed_edges(spark, sf), graph_symbols(spark, sf), changed_paths(spark, sf)).drop("repository_id"), """
SELECT changed_file_path, dependent_file_path, dependent_symbol_name, edge_type FROM typed
WHERE changed_file_path IS NOT NULL AND substr(changed_file_path, 2)::BIGINT % 4 = 1""")


def pr_files(spark, sf):
    """Customers' files as changed by one pull request per nation."""
    return b.table(spark, sf, "customer").select(
        F.expr(b.repository_of("c_custkey")).alias("repository_id"), F.col("c_nationkey").alias("number"),
        F.concat(F.lit("f"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("filename"),
        F.when(F.col("c_custkey") % 5 == 0, "removed").otherwise("modified").alias("status"))


b.CTES["touched"] = "SELECT DISTINCT 'r' || (c_custkey // 10 % 7) AS repository_id, c_nationkey AS number, 'f' || (c_custkey // 10) AS changed_file_path FROM customer WHERE c_custkey % 5 <> 0"
add("gr13_pr_impact_totals", lambda spark, sf: graphs.pr_impact(pr_files(spark, sf), typed_edges(spark, sf), graph_symbols(spark, sf))[0], """
SELECT repository_id, number, count(t.edge_type) AS total_dependents, count(t.edge_type) > 50 AS truncated
FROM touched LEFT JOIN typed t USING (repository_id, changed_file_path) GROUP BY 1, 2""")
add("gr13_pr_impact_list", lambda spark, sf: graphs.pr_impact(pr_files(spark, sf), typed_edges(spark, sf), graph_symbols(spark, sf), 10)[1].select(
    "repository_id", "number", "changed_file_path", "dependent_symbol_name", "edge_type", "position"), """
SELECT repository_id, number, changed_file_path, dependent_symbol_name, edge_type, row_number() OVER (PARTITION BY repository_id, number ORDER BY changed_file_path,
  dependent_file_path, dependent_symbol_name, edge_type, source_symbol_id)::INTEGER AS position
FROM touched JOIN typed USING (repository_id, changed_file_path) QUALIFY position <= 10""")
add("gr14_named_edges", lambda spark, sf: graphs.named_edges(typed_edges(spark, sf), graph_symbols(spark, sf), 40), """
SELECT repository_id, row_number() OVER (PARTITION BY repository_id ORDER BY source_symbol_id, edge_type, target_symbol_id NULLS FIRST, target_package_name NULLS FIRST)::INTEGER AS position,
       dependent_symbol_name AS source, source_kind, coalesce(target_name, target_package_name) AS target, edge_type,
       count(*) OVER (PARTITION BY repository_id) AS total_edges, count(*) OVER (PARTITION BY repository_id) > 40 AS truncated
FROM typed QUALIFY position <= 40""")


def plans(spark, sf):
    """Each customer's orders as the steps of one plan; some point past its end."""
    orders = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    steps = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    shaped = F.transform("o", lambda s, i: F.struct(
        i.cast("string").alias("id"),
        F.when(s["o_orderpriority"] == "1-URGENT", "validation").otherwise("tool").alias("type"),
        F.when(s["o_orderkey"] % 3 != 0, F.array((s["o_orderkey"] % (F.size("o") + 1)).cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("depends_on")))
    return steps.select(F.col("o_custkey").alias("id"), shaped.alias("steps"))


add("gr16_plan_defects", lambda spark, sf: graphs.plan_defects(plans(spark, sf)), """
WITH RECURSIVE steps AS (
  SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS step, count(*) OVER (PARTITION BY o_custkey) AS n,
         o_orderkey, o_orderpriority FROM orders),
linked AS (SELECT id, step::VARCHAR AS step_id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % (n + 1))::VARCHAR END AS dep, n FROM steps),
runs AS (SELECT id, step_id FROM linked WHERE dep IS NULL UNION SELECT l.id, l.step_id FROM linked l JOIN runs r ON r.id = l.id AND r.step_id = l.dep)
SELECT id, 'MISSING_DEPENDENCY' AS defect, step_id, dep AS detail FROM linked WHERE dep = n::VARCHAR
UNION ALL SELECT id, 'UNREACHABLE_STEP', step_id, NULL FROM linked l WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id = l.id AND r.step_id = l.step_id)
UNION ALL SELECT o_custkey, 'NO_VALIDATION_STEP', NULL, NULL FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderpriority = '1-URGENT')""")
