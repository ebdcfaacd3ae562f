"""What the shared tables stand for in the registered queries.

Every binding reads whole tables and grows with them. The matching DuckDB
views are common table expressions in `CTES`; `with_ctes` puts the needed ones
in front of an oracle query.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans import sample_trees
from tidemark.session import deal_by, land_by
from tidemark.sources.tables import read_table

CTES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """`body` with every common table expression it reads (after FROM or JOIN), in order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, cte in CTES.items():
            if name not in needed and re.search(rf"(?i)\b(?:from|join)\s+{name}\b", sql):
                visit(cte)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed)
    rest = body.strip()
    recursive = rest.upper().startswith("WITH RECURSIVE")
    if recursive:
        return f"WITH RECURSIVE {head},\n{rest[len('WITH RECURSIVE'):]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {head},\n{rest[len('WITH'):]}"
    return f"WITH {head}\n{rest}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    return read_table(spark, f"{sf}/{name}.parquet", *columns)


# --- documents as source files -------------------------------------------------

def document_files(spark, sf) -> DataFrame:
    return wide(spark, sf, "documents", "source", "doc_id", "text").select(
        F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("path"),
        F.lit("text").alias("language"), F.col("text").alias("content"),
    )


CTES["doc_files"] = """
SELECT source AS repository_id, doc_id::VARCHAR AS path, 'text' AS language, text AS content FROM documents"""

CTES["doc_lines"] = """
SELECT repository_id, path AS file_path, line, line_no
FROM (SELECT repository_id, path, unnest(string_split(content, chr(10))) AS line,
             unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM doc_files)"""


# --- parts as source files whose lines carry what the rules look for ------------

CODE_LINES = [
    ("true", "'import lib_' || (p_partkey % 7)"),
    ("p_partkey % 5 = 0", "'const q = \"SELECT * FROM t WHERE id = \" + ' || p_partkey"),
    ("p_partkey % 9 = 8", "'sql = f\"{table} DELETE FROM x\"'"),
    ("p_partkey % 6 = 1", "'requests.get(u, verify=False)'"),
    ("p_partkey % 7 = 2", "'logger.info(\"password \" + value)'"),
    ("p_partkey % 8 = 3", "'jwt.sign(payload, \"abc' || (p_partkey % 10) || '\")'"),
    ("p_partkey % 8 = 3 AND p_partkey % 3 = 0", "'jwt.verify(t, \"k\", { algorithms: [\"none\"] })'"),
    ("p_partkey % 3 = 1", "'opts = { algorithm: \"none\" }'"),
    ("p_partkey % 6 = 2", "'  el.innerHTML = value' || p_size"),
    ("p_partkey % 11 = 0", "'{{ value | safe }}'"),
    ("p_partkey % 10 = 5", "'cors({ origin: \"*\" })'"),
    ("p_partkey % 4 = 1", "'credentials: true'"),
    ("p_partkey % 7 = 0", "'DEBUG = True'"),
    ("p_partkey % 13 = 0", "'  debug: true,'"),
    ("p_partkey % 5 = 3", "'if (password == input) {'"),
    ("p_partkey % 10 = 3", "'const bcrypt = require(\"bcrypt\")'"),
    ("p_partkey % 50 = 7", "'app.use(req.session)'"),
    ("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_partkey % 3 = 0", "'app.use(csrf())'"),
    ("p_partkey % 12 = 6", "'api_key = \"abcdefgh' || p_partkey || '\"'"),
    ("p_partkey % 14 = 1", "'AKIA' || 'ABCDEFGHIJKLMNO' || (p_partkey % 10)"),
    ("p_partkey % 15 = 2", "'Authorization: Bearer abcdefghijklmnopqrstuvwxyz'"),
    ("p_partkey % 9 = 2", "'@lru_cache'"),
    ("true", "'return lib_' || (p_partkey % 11)"),
]
CODE_CONTENT = "concat_ws(chr(10), " + ", ".join(
    f"CASE WHEN {when} THEN {line} END" for when, line in CODE_LINES) + ")"
CODE_EXTENSION = "CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.java' END"
CODE_FOLDER = (
    "CASE p_size % 9 WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'models' WHEN 3 THEN 'infra' "
    "WHEN 4 THEN 'node_modules' WHEN 5 THEN 'api' WHEN 6 THEN 'lib' WHEN 7 THEN 'db' ELSE 'util' END"
)
CODE_PATH = f"'src/' || {CODE_FOLDER} || '/f' || p_partkey || {CODE_EXTENSION}"


def code_files(spark, sf) -> DataFrame:
    return wide(spark, sf, "part").select(
        F.col("p_brand").alias("repository_id"), F.expr(CODE_PATH).alias("path"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' "
               "ELSE 'java' END").alias("language"),
        F.expr(CODE_CONTENT).alias("content"),
    )


CTES["code_files"] = f"""
SELECT p_brand AS repository_id, {CODE_PATH} AS path,
       CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' ELSE 'java' END
           AS language, {CODE_CONTENT} AS content FROM part"""

CTES["code_lines"] = """
SELECT repository_id, path AS file_path, line, line_no
FROM (SELECT repository_id, path, unnest(string_split(content, chr(10))) AS line,
             unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM code_files)"""


# --- parts as classes, their sizes as methods ------------------------------------

METHOD_NAMES = [
    "getInstance", "createItem", "findAll", "save", "subscribe", "emit", "build", "deleteOne", "handle",
    "onEvent", "notifyAll", "makeThing", "listItems", "update", "run", "add_listener", "dispatch", "instance",
]
CLASS_SUFFIXES = ["", "Factory", "Repository", "Builder", "Adapter", "Decorator", "Facade", "Repo", "Service", "Model"]


def _pick(names: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(names)) + " END"


CLASS_COLUMNS = {
    "id": "'c' || p_partkey",
    "repository_id": "p_brand",
    "file_path": "'src/' || lower(p_type) || '/f' || (p_partkey % 40) || '.ts'",
    "parent_id": "CAST(NULL AS {str})",
    "kind": "CASE WHEN p_partkey % 9 = 0 THEN 'INTERFACE' ELSE 'CLASS' END",
    "name": f"replace(p_name, ' ', '') || ({_pick(CLASS_SUFFIXES, 'p_partkey % 10')})",
    "signature": "'class ' || p_name",
    "doc_comment": "CASE WHEN p_partkey % 3 = 0 THEN 'About ' || p_name END",
    "start_line": "1",
    "end_line": "p_size * 20",
    "deco1": "CASE p_partkey % 4 WHEN 0 THEN '@Controller(\"/' || lower(p_type) || '/\")' WHEN 1 THEN "
             "'@RequestMapping(value = \"/' || p_size || '\")' WHEN 2 THEN '@Injectable()' END",
    "deco2": "CASE WHEN p_partkey % 6 = 0 THEN '@UseGuards(AuthGuard)' END",
    "superclasses": "CASE p_partkey % 4 WHEN 0 THEN 'Base' || (p_partkey % 30) WHEN 1 THEN 'object' WHEN 2 THEN '' END",
    "interfaces": "CASE p_partkey % 6 WHEN 0 THEN 'IOne' || (p_partkey % 20) || ', ITwo' WHEN 1 THEN ' , IOne' "
                  "|| (p_partkey % 20) END",
}
METHOD_COLUMNS = {
    "id": "'m' || p_partkey || '_' || i",
    "repository_id": "p_brand",
    "file_path": CLASS_COLUMNS["file_path"],
    "parent_id": "'c' || p_partkey",
    "kind": "'METHOD'",
    "name": _pick(METHOD_NAMES, "(p_partkey + i * 3) % 18"),
    "signature": "'m' || i || '()'",
    "doc_comment": "CASE WHEN (p_partkey + i) % 3 = 0 THEN 'Does ' || i END",
    "start_line": "10 * i + 2",
    "end_line": "10 * i + 8",
    "deco1": "CASE WHEN (p_partkey + i) % 5 = 0 THEN '@Roles(\"a\")' WHEN (p_partkey + i) % 11 = 1 "
             "THEN '@RolesAllowed(\"x\")' END",
    "deco2": "CASE (p_partkey + i) % 8 WHEN 0 THEN '@Get(\"x' || i || '\")' WHEN 1 THEN '@PostMapping(\"/y\")' "
             "WHEN 2 THEN '@app.route(\"/z\", methods=[\"put\", \"GET\"])' WHEN 3 THEN '@router.get(\"/w/\")' "
             "WHEN 4 THEN '@RequestMapping(\"/r\")' WHEN 5 THEN '@All()' END",
    "superclasses": "CAST(NULL AS {str})",
    "interfaces": "CAST(NULL AS {str})",
}


def _spark_columns(spec: dict[str, str]) -> list:
    plain = [F.expr(sql.replace("{str}", "string")).alias(name) for name, sql in spec.items()
             if name not in ("deco1", "deco2")]
    decorators = F.array_compact(F.array(F.expr(spec["deco1"]), F.expr(spec["deco2"])))
    return [*plain, decorators.alias("decorators")]


def _duck_columns(spec: dict[str, str]) -> str:
    plain = [f"{sql.replace('{str}', 'VARCHAR')} AS {name}" for name, sql in spec.items()
             if name not in ("deco1", "deco2")]
    decorators = f"list_filter([{spec['deco1']}, {spec['deco2']}], lambda x: x IS NOT NULL) AS decorators"
    return ", ".join([*plain, decorators])


def class_symbols(spark, sf) -> DataFrame:
    part = wide(spark, sf, "part")
    methods = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p_size") % 18)))
    return part.select(*_spark_columns(CLASS_COLUMNS)).unionByName(methods.select(*_spark_columns(METHOD_COLUMNS)))


CTES["class_symbols"] = f"""
SELECT {_duck_columns(CLASS_COLUMNS)} FROM part
UNION ALL BY NAME
SELECT {_duck_columns(METHOD_COLUMNS)} FROM (SELECT *, unnest(range(0, p_size % 18 + 1)) AS i FROM part)"""


# --- documents as parsed files -------------------------------------------------------

# A document is a file, each of its lines one construct of the file's language:
# which one, and the digit in its names, follows from the length of the line.
AST_LANGUAGES = ("python", "javascript", "java")
AST_LANGUAGE = "CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'java' END"
AST_REPOSITORY = "concat('Brand#', doc_id % 25 + 1)"
AST_FILE = "concat('d', doc_id)"
AST_NUMBER = "length(line) % CASE doc_id % 3 " + " ".join(
    f"WHEN {n} THEN {len(sample_trees.constructs(name))}" for n, name in enumerate(AST_LANGUAGES)) + " END"
NODE_FIELDS = {
    "node_id": "int", "parent_id": "int", "pre": "int", "post": "int", "type": "string", "is_named": "boolean", "field": "string",
    "text": "string", "start_byte": "int", "end_byte": "int", "start_line": "int", "end_line": "int",
}
UNIT_SIZES = ("size", "ticks", "bytes", "lines")
NODE_DDL = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in NODE_FIELDS.items()) + ">>"


def _lines_by_file(spark, sf) -> DataFrame:
    """One row per document, dealt by file: all that its tree takes from the text is how long each line is."""
    docs = wide(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.expr(AST_REPOSITORY).alias("repository_id"), F.expr(AST_FILE).alias("file_path"),
        F.expr(AST_LANGUAGE).alias("language"), F.transform(F.split("text", "\n"), F.length).alias("lengths"))
    return deal_by(docs, "repository_id", "file_path")


def _of_unit(name: str, kind: str) -> Column:
    """`name` of a line's construct."""
    known = {language: F.from_json(F.lit(json.dumps([unit[name] for unit in sample_trees.units(language)])), f"array<{kind}>")
             for language in AST_LANGUAGES}
    of_language = F.when(F.col("language") == "python", known["python"]).when(
        F.col("language") == "javascript", known["javascript"]).otherwise(known["java"])
    return F.element_at(of_language, F.col("number") + 1)


def _placed_units(docs: DataFrame) -> DataFrame:
    """One row per line: the number of its construct, digit, and how much of the file lies before it.

    Constructs themselves are looked up after the window, which so sorts lines of a few numbers.
    """
    lines = docs.select("doc_id", "repository_id", "file_path", "language", F.posexplode("lengths").alias("pos", "length"))
    chosen = lines.select(
        "repository_id", "file_path", "language", "pos", F.expr("cast(length % 10 as string)").alias("digit"),
        F.expr(AST_NUMBER.replace("length(line)", "length")).alias("number"))
    before = Window.partitionBy("repository_id", "file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sized = chosen.select("*", *[_of_unit(name, "int").alias(f"own_{name}") for name in UNIT_SIZES])
    return sized.select("*", *[F.coalesce(F.sum(f"own_{name}").over(before), F.lit(0)).cast("int").alias(f"past_{name}")
                               for name in UNIT_SIZES])


def ast_nodes(spark, sf) -> DataFrame:
    """The trees of all documents, by file.

    What is landed is the lines they are made of, some hundredth of the texts;
    nodes, some ten times the texts, are made where they are read.
    """
    placed = _placed_units(land_by(_lines_by_file(spark, sf), "repository_id", "file_path", dealt=True))
    file = ["repository_id", "file_path", "language"]
    whole = Window.partitionBy("repository_id", "file_path")
    total = {name: F.sum(f"own_{name}").over(whole).cast("int") for name in UNIT_SIZES}
    placed = placed.select("*", (F.row_number().over(whole.orderBy("pos")) == 1).alias("opens"),
                           *[value.alias(f"all_{name}") for name, value in total.items()])
    # A file's root comes with its first line, numbered so that what is added below gives 0, or 1 for lines.
    root = {"node_id": F.lit(0), "pre": F.lit(-1), "post": F.col("all_ticks"), "type": F.lit("program"), "is_named": F.lit(True), "text": F.lit(""),
            "start_byte": F.lit(0), "end_byte": F.col("all_bytes"), "start_line": F.lit(0), "end_line": F.col("all_lines")}
    first = F.struct(*[root.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in NODE_FIELDS.items()])
    own = _of_unit("nodes", NODE_DDL)
    made = F.when(F.col("opens"), F.concat(F.array(first), F.coalesce(own, F.array().cast(NODE_DDL)))).otherwise(own)
    nodes = placed.select(*file, "digit", *[f"past_{name}" for name in UNIT_SIZES], F.inline(made))
    return nodes.select(
        *file, (F.col("past_size") + F.col("node_id")).alias("node_id"),
        F.when(F.col("parent_id") > 0, F.col("past_size") + F.col("parent_id")).when(F.col("parent_id").isNotNull(), 0).alias("parent_id"),
        (F.col("past_ticks") + F.col("pre") + 1).alias("pre"), (F.col("past_ticks") + F.col("post") + 1).alias("post"),
        "type", "is_named", "field", F.replace("text", F.lit("#"), "digit").alias("text"),
        (F.col("past_bytes") + F.col("start_byte")).alias("start_byte"), (F.col("past_bytes") + F.col("end_byte")).alias("end_byte"),
        (F.col("past_lines") + F.col("start_line") + 1).alias("start_line"), (F.col("past_lines") + F.col("end_line") + 1).alias("end_line"))


def ast_files(spark, sf) -> DataFrame:
    """The source texts of the same files."""
    piece = F.replace(_of_unit("source", "string"), F.lit("#"), F.col("digit"))
    pieces = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return _placed_units(_lines_by_file(spark, sf)).groupBy("repository_id", F.col("file_path").alias("path"), "language").agg(
        F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("content"))


def _duck_units() -> str:
    shape = "[{" + ",".join(f'"{name}":"{kind.upper().replace("STRING", "VARCHAR").replace("INT", "INTEGER")}"'
                            for name, kind in NODE_FIELDS.items()) + "}]"
    rows = []
    for name in AST_LANGUAGES:
        for number, unit in enumerate(sample_trees.units(name)):
            sizes = ", ".join(f"{unit[key]} AS {key}" for key in UNIT_SIZES)
            rows.append(f"SELECT '{name}' AS language, {number} AS number, {sizes}, {_sql_text(unit['source'])} AS source, "
                        f"from_json({_sql_text(json.dumps(unit['nodes']))}, '{shape}') AS nodes")
    return " UNION ALL ".join(rows)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CTES["ast_units"] = _duck_units()
CTES["ast_lines"] = f"""
SELECT {AST_REPOSITORY} AS repository_id, {AST_FILE} AS file_path, {AST_LANGUAGE} AS language, pos, {AST_NUMBER} AS number,
       (length(line) % 10)::VARCHAR AS digit
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)"""
CTES["ast_placed"] = "SELECT l.*, u.source, u.nodes, " + ", ".join(
    f"u.{key}, (coalesce(sum(u.{key}) OVER (PARTITION BY l.file_path ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER "
    f"AS past_{key}" for key in UNIT_SIZES) + " FROM ast_lines l JOIN ast_units u USING (language, number)"
CTES["ast_nodes"] = """
SELECT repository_id, file_path, language, (past_size + node_id)::INTEGER AS node_id,
       (CASE WHEN parent_id > 0 THEN past_size + parent_id ELSE 0 END)::INTEGER AS parent_id, (past_ticks + pre + 1)::INTEGER AS pre,
       (past_ticks + post + 1)::INTEGER AS post, type, is_named, field, replace(text, '#', digit) AS text,
       (past_bytes + start_byte)::INTEGER AS start_byte, (past_bytes + end_byte)::INTEGER AS end_byte,
       (past_lines + start_line + 1)::INTEGER AS start_line, (past_lines + end_line + 1)::INTEGER AS end_line
FROM (SELECT * EXCLUDE (nodes, size, ticks, bytes, lines, source), unnest(nodes, recursive := true) FROM ast_placed)
UNION ALL
SELECT repository_id, file_path, language, 0, NULL, 0, (sum(ticks) + 1)::INTEGER, 'program', true, NULL, '', 0, sum(bytes)::INTEGER, 1,
       (sum(lines) + 1)::INTEGER
FROM ast_placed GROUP BY ALL"""
CTES["ast_files"] = """
SELECT repository_id, file_path AS path, language, string_agg(replace(source, '#', digit), '' ORDER BY pos) AS content
FROM ast_placed GROUP BY ALL"""


# --- web pages as syntax trees ------------------------------------------------------

CONTAINERS = ["head", "title", "nav", "ul", "li", "a", "div", "article", "h1", "footer"]
LEAVES = ["p", "b", "br", "meta"]
NOISE = r"<script[\s\S]*?</script>|<style[\s\S]*?</style>|<!--[\s\S]*?-->"
TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>([^<]*)"

# The tags play the roles that node types play in a language profile.
PAGE_ROLES = {
    "html": {
        "function": ["nav", "article", "footer"], "loop": ["ul", "li"], "call": ["a"], "literal": ["ul"],
        "decision": ["li", "p", "b"], "nesting": ["ul", "li", "div"], "branch": ["li"], "pair": ["li"],
    }
}


def page_trees(spark, sf) -> DataFrame:
    """Tags of each page as nodes with nested-set numbers; `page_id` is the file.

    Pages are dealt by file before they are taken apart, so all windows below
    and what follows them find a file's nodes together.
    """
    pages = deal_by(wide(spark, sf, "pages", "page_id", "html").select(
        (F.col("page_id") % 5).cast("string").alias("repository_id"), F.col("page_id").cast("string").alias("file_path"), "html"),
        "repository_id", "file_path").select(
        "repository_id", "file_path", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", NOISE, ""), F.lit(TAG), F.lit(0))).alias("pos", "raw"),
    )
    tags = pages.select(
        "repository_id", "file_path", "pos", F.lower(F.regexp_extract("raw", TAG, 2)).alias("type"),
        (F.regexp_extract("raw", TAG, 1) == "/").alias("closes"),
        F.regexp_extract("raw", TAG, 3).alias("attributes"), F.trim(F.regexp_extract("raw", TAG, 4)).alias("text"),
    ).filter(F.col("type").isin(CONTAINERS) | (F.col("type").isin(LEAVES) & ~F.col("closes")))
    ordered = Window.partitionBy("repository_id", "file_path").orderBy("pos")
    step = F.when(F.col("type").isin(LEAVES), 0).when(F.col("closes"), -1).otherwise(1)
    running = F.sum(step).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.when(F.col("type").isin(LEAVES), running + 1).when(F.col("closes"), running + 1).otherwise(running)
    leveled = tags.withColumn("level", level.cast("int"))
    same = Window.partitionBy("repository_id", "file_path", "level").orderBy("pos")
    container = ~F.col("type").isin(LEAVES)
    next_close = F.first(F.when(container & F.col("closes"), F.col("pos")), ignorenulls=True).over(
        same.rowsBetween(1, Window.unboundedFollowing))
    numbered = leveled.withColumn("post", F.when(container, next_close).otherwise(F.col("pos"))).filter(~F.col("closes"))
    # Parents: the last node opened one level up; both sides share the level key.
    own = numbered.select("*", F.col("level").alias("_at"), F.lit(1).alias("_side"))
    as_parent = numbered.filter(container).select("*", (F.col("level") + 1).alias("_at"), F.lit(0).alias("_side"))
    under = Window.partitionBy("repository_id", "file_path", "_at").orderBy("pos", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    linked = own.unionByName(as_parent).withColumn(
        "parent_id", F.last(F.when(F.col("_side") == 0, F.col("pos")), ignorenulls=True).over(under)
    ).filter(F.col("_side") == 1)
    return linked.select(
        "repository_id", "file_path", F.lit("html").alias("language"), F.col("pos").alias("node_id"),
        F.col("parent_id").cast("int"), F.col("pos").alias("pre"), F.col("post").cast("int"), "type",
        (~F.col("type").isin("br", "meta")).alias("is_named"), F.lit(None).cast("string").alias("field"), "text",
        "attributes", F.col("pos").alias("start_byte"), F.col("post").cast("int").alias("end_byte"),
        (F.col("pos") + 1).alias("start_line"), (F.col("post") + 1).cast("int").alias("end_line"),
    )


_containers = ", ".join(f"'{x}'" for x in CONTAINERS)
_leaves = ", ".join(f"'{x}'" for x in LEAVES)
CTES["page_tags"] = f"""
SELECT * FROM (
  SELECT repository_id, file_path, pos::INTEGER AS pos, lower(regexp_extract(raw, '{TAG}', 2)) AS type,
         regexp_extract(raw, '{TAG}', 1) = '/' AS closes, regexp_extract(raw, '{TAG}', 3) AS attributes,
         trim(regexp_extract(raw, '{TAG}', 4), ' ') AS text
  FROM (SELECT repository_id, file_path, unnest(raws) AS raw, unnest(range(0, len(raws))) AS pos
        FROM (SELECT (page_id % 5)::VARCHAR AS repository_id, page_id::VARCHAR AS file_path,
                     regexp_extract_all(regexp_replace(html, '{NOISE}', '', 'g'), '{TAG}', 0) AS raws FROM pages)))
WHERE type IN ({_containers}) OR (type IN ({_leaves}) AND NOT closes)"""
CTES["page_levels"] = f"""
SELECT *, CASE WHEN type IN ({_leaves}) THEN 1 WHEN closes THEN 1 ELSE 0 END
         + sum(CASE WHEN type IN ({_leaves}) THEN 0 WHEN closes THEN -1 ELSE 1 END)
           OVER (PARTITION BY file_path ORDER BY pos) AS level FROM page_tags"""
CTES["page_spans"] = f"""
SELECT * FROM (SELECT *, CASE WHEN type IN ({_leaves}) THEN pos ELSE
         min(CASE WHEN closes THEN pos END) OVER (PARTITION BY file_path, level ORDER BY pos
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS post FROM page_levels) WHERE NOT closes"""
CTES["page_trees"] = f"""
SELECT s.repository_id, s.file_path, 'html' AS language, s.pos AS node_id,
       (SELECT max(p.pos) FROM page_spans p WHERE p.file_path = s.file_path AND p.level = s.level - 1
          AND p.type IN ({_containers}) AND p.pos < s.pos) AS parent_id,
       s.pos AS pre, s.post::INTEGER AS post, s.type, s.type NOT IN ('br', 'meta') AS is_named,
       NULL::VARCHAR AS field, s.text, s.attributes, s.pos AS start_byte, s.post::INTEGER AS end_byte,
       s.pos + 1 AS start_line, (s.post + 1)::INTEGER AS end_line
FROM page_spans s"""


# --- graphs ------------------------------------------------------------------------

def repository_of(customer: str) -> str:
    """The repository a customer's file lies in; both ends of an edge share it."""
    return f"concat('r', CAST(floor({customer} / 10) AS bigint) % 7)"


def graph_edges(spark, sf) -> DataFrame:
    """Orders as edges; customers are files, every ten of them in one of seven repositories."""
    return (
        table(spark, sf, "orders")
        .selectExpr(f"{repository_of('o_custkey')} AS repository_id", "CAST(o_custkey AS string) AS src",
                    "CAST(CAST(floor(o_custkey / 10) AS bigint) * 10 + o_orderkey % 10 AS string) AS dst")
        .filter("src <> dst").distinct()
    )


CTES["graph"] = """
SELECT DISTINCT 'r' || (o_custkey // 10 % 7) AS repository_id, o_custkey::VARCHAR AS src,
       ((o_custkey // 10) * 10 + o_orderkey % 10)::VARCHAR AS dst
FROM orders WHERE o_custkey <> (o_custkey // 10) * 10 + o_orderkey % 10"""


def dag_edges(spark, sf) -> DataFrame:
    """The same edges, but only from a smaller number to a larger one, in one repository."""
    return graph_edges(spark, sf).filter("CAST(src AS bigint) < CAST(dst AS bigint)").select(
        F.lit("r0").alias("repository_id"), "src", "dst")


CTES["dag"] = "SELECT 'r0' AS repository_id, src, dst FROM graph WHERE src::BIGINT < dst::BIGINT"


# --- events ------------------------------------------------------------------------

def events(spark, sf, kind: str | None = None) -> DataFrame:
    df = table(spark, sf, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id"), "event_type", "value", "props",
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("service_id"),
        F.concat(F.lit("r"), F.col("user_id")).alias("repository_id"),
    )
    return df.filter(F.col("event_type") == kind) if kind else df


CTES["ev"] = """
SELECT event_id, ts, user_id, event_type, value, props, 's' || (user_id % 20) AS service_id,
       'r' || user_id AS repository_id FROM events"""


def alerts(spark, sf) -> DataFrame:
    """Errors as alerts, every one delivered twice; two in eleven come back resolved or unlabelled."""
    ev = events(spark, sf, "error")
    label = F.element_at(F.array(*[F.lit(x) for x in ("critical", "page", "High", "warning", "info", "odd")]),
                         (F.col("event_id") % 6 + 1).cast("int"))
    one = ev.select(
        F.lit("o1").alias("organization_id"), F.lit("i1").alias("integration_id"),
        F.concat(F.lit("fp"), F.col("event_id")).alias("fingerprint"),
        F.when(F.col("event_id") % 11 == 0, F.lit("resolved")).otherwise(F.lit("firing")).alias("status"),
        F.map_from_entries(F.filter(F.array(
            F.when(F.col("event_id") % 11 != 1, F.struct(F.lit("service").alias("key"), F.concat(F.lit("svc-"), F.col("user_id") % 25).alias("value"))),
            F.when(F.col("event_id") % 7 != 0, F.struct(F.lit("severity").alias("key"), label.alias("value"))),
            F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("alertname").alias("key"), F.concat(F.lit("A"), F.col("event_id") % 5).alias("value"))),
        ), lambda e: e.isNotNull())).alias("labels"),
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("summary"), F.when(F.col("event_id") % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("Error "), "event_id"))))
        .otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))).alias("annotations"),
        F.col("ts").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), F.col("ts").alias("received_at"),
        F.col("event_id"),
    )
    again = one.withColumn("received_at", F.expr("received_at + INTERVAL 5 SECONDS"))
    return one.unionByName(again)


def services(spark, sf) -> DataFrame:
    """Twenty services per user block; only svc-0 to svc-19 are registered."""
    ids = table(spark, sf, "events").select((F.col("user_id") % 20).alias("n")).distinct()
    return ids.select(
        F.concat(F.lit("s"), "n").alias("id"), F.lit("o1").alias("organization_id"),
        F.concat(F.lit("r"), F.col("n") % 4).alias("repository_id"), F.concat(F.lit("svc-"), "n").alias("name"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("u"), "n")).alias("owner_user_id"),
        F.when(F.col("n") % 5 == 0, "HIGH").otherwise("LOW").alias("criticality"),
    )


CTES["alerts_once"] = """
SELECT 'fp' || event_id AS fingerprint, CASE WHEN event_id % 11 = 0 THEN 'resolved' ELSE 'firing' END AS status,
       CASE WHEN event_id % 11 <> 1 THEN 'svc-' || (user_id % 25) END AS service_label,
       CASE WHEN event_id % 7 <> 0 THEN
         (['critical', 'page', 'High', 'warning', 'info', 'odd'])[event_id % 6 + 1] END AS severity_label,
       CASE WHEN event_id % 3 = 0 THEN 'A' || (event_id % 5) END AS alertname,
       CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 8 = 0 THEN '' ELSE 'Error ' || event_id END END AS summary,
       ts AS starts_at, event_id
FROM events WHERE event_type = 'error'"""
CTES["svc_reg"] = """
SELECT 's' || n AS id, 'o1' AS organization_id, 'r' || (n % 4) AS repository_id, 'svc-' || n AS name,
       CASE WHEN n % 3 = 0 THEN 'u' || n END AS owner_user_id, CASE WHEN n % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS criticality
FROM (SELECT DISTINCT user_id % 20 AS n FROM events)"""


def incidents(spark, sf) -> DataFrame:
    return events(spark, sf, "error").select(
        F.concat(F.lit("i"), "event_id").alias("id"), F.lit("o1").alias("organization_id"), "service_id",
        "repository_id", F.concat(F.lit("Incident "), "event_id").alias("title"),
        F.element_at(F.array(*[F.lit(x) for x in ("DETECTED", "INVESTIGATING", "ROOT_CAUSED", "RESOLVED")]),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "HIGH")]),
                     (F.col("event_id") % 5 + 1).cast("int")).alias("severity"),
        F.col("ts").alias("detected_at"),
        F.when(F.col("event_id") % 10 == 0, F.lit("d0")).alias("deployment_id"), "event_id",
    )


def deployments(spark, sf) -> DataFrame:
    return events(spark, sf, "purchase").select(
        F.concat(F.lit("d"), "event_id").alias("id"), F.lit("o1").alias("organization_id"), "service_id", "repository_id",
        (F.col("event_id") - 1).cast("string").alias("commit_sha"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("v"), F.col("event_id") % 100)).alias("version"),
        F.when(F.col("event_id") % 2 == 0, "main").otherwise("staging").alias("environment"),
        F.when(F.col("event_id") % 5 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("deployed_at"), "event_id",
    )


def commits(spark, sf) -> DataFrame:
    return events(spark, sf, "click").select(
        F.col("event_id").cast("string").alias("sha"), "repository_id",
        F.concat(F.lit("Change "), "event_id", F.lit("\nbody")).alias("message"),
        F.concat(F.lit("Author "), F.col("user_id")).alias("author_name"),
        F.concat(F.lit("u"), F.col("user_id") % 30, F.lit("@x.org")).alias("author_email"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("login"), "user_id")).alias("author_login"),
        F.col("ts").alias("committed_at"), "event_id",
    )


def pull_requests(spark, sf) -> DataFrame:
    return events(spark, sf, "signup").select(
        F.concat(F.lit("p"), "event_id").alias("id"), "service_id", "repository_id",
        F.col("event_id").cast("int").alias("number"), F.concat(F.lit("PR "), "event_id").alias("title"),
        F.lit("MERGED").alias("state"), F.concat(F.lit("login"), "user_id").alias("author_login"),
        F.col("ts").alias("merged_at"), "event_id",
    )


CTES["incidents_ev"] = """
SELECT 'i' || event_id AS id, 'o1' AS organization_id, service_id, repository_id, 'Incident ' || event_id AS title,
       (['DETECTED', 'INVESTIGATING', 'ROOT_CAUSED', 'RESOLVED'])[event_id % 4 + 1] AS status,
       (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'HIGH'])[event_id % 5 + 1] AS severity, ts AS detected_at,
       CASE WHEN event_id % 10 = 0 THEN 'd0' END AS deployment_id, event_id FROM ev WHERE event_type = 'error'"""
CTES["deployments_ev"] = """
SELECT 'd' || event_id AS id, 'o1' AS organization_id, service_id, repository_id, (event_id - 1)::VARCHAR AS commit_sha,
       CASE WHEN event_id % 3 <> 0 THEN 'v' || (event_id % 100) END AS version,
       CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'staging' END AS environment,
       CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, ts AS deployed_at, event_id
FROM ev WHERE event_type = 'purchase'"""
CTES["commits_ev"] = """
SELECT event_id::VARCHAR AS sha, repository_id, 'Change ' || event_id || chr(10) || 'body' AS message,
       'Author ' || user_id AS author_name, 'u' || (user_id % 30) || '@x.org' AS author_email,
       CASE WHEN event_id % 2 = 0 THEN 'login' || user_id END AS author_login, ts AS committed_at, event_id
FROM ev WHERE event_type = 'click'"""
CTES["prs_ev"] = """
SELECT 'p' || event_id AS id, service_id, repository_id, event_id::INTEGER AS number, 'PR ' || event_id AS title,
       'login' || user_id AS author_login, ts AS merged_at, event_id FROM ev WHERE event_type = 'signup'"""


def findings(spark, sf) -> DataFrame:
    """Events as findings; one analysis per user and day."""
    return events(spark, sf).select(
        F.col("event_id").cast("string").alias("id"), "repository_id",
        F.concat("repository_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("analysis_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("SECURITY", "PERFORMANCE", "DEPENDENCY", "QUALITY")]),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in FINDING_TYPES]), (F.col("event_id") % len(FINDING_TYPES) + 1).cast("int")).alias("type"),
        F.expr("CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM' "
               "WHEN 'view' THEN 'LOW' ELSE 'INFO' END").alias("severity"),
        F.lit(None).cast("string").alias("priority"),
        F.concat(F.lit("Finding "), "event_id").alias("title"), F.lit("why").alias("explanation"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ev "), "event_id")).alias("evidence"),
        F.when(F.col("event_id") % 2 == 0, F.lit("fix it")).alias("suggested_fix"),
        (F.floor("value") % 101).cast("int").alias("confidence"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("f"), F.col("event_id") % 50)).alias("file_path"),
        F.when(F.col("event_id") % 4 != 1, F.concat(F.lit("Sym"), F.col("event_id") % 13)).alias("symbol_name"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 9 + 1).cast("int")).alias("start_line"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 9 + 3).cast("int")).alias("end_line"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("f"), F.col("event_id") % 50), F.concat(F.lit("f"), F.col("event_id") % 31)))
        .otherwise(F.array().cast("array<string>")).alias("related_files"),
        F.expr(METADATA).alias("metadata"), F.col("ts").alias("created_at"),
    )


FINDING_TYPES = [
    "HIGH_COMPLEXITY", "N_PLUS_ONE_QUERY", "LAYER_VIOLATION", "LARGE_CLASS", "HARDCODED_SECRET", "BLOCKING_OPERATION",
    "SINGLETON", "MISSING_CACHING", "UNSAFE_DEPENDENCY", "SRP_CANDIDATE", "CIRCULAR_DEPENDENCY", "DUPLICATE_LOGIC",
    "SOMETHING_ELSE",
]
METADATA = (
    "CASE event_id % 10 WHEN 0 THEN '{\"complexity\": ' || event_id || '}' "
    "WHEN 1 THEN '{\"cycle\": [\"a\", \"b' || (event_id % 6) || '\", \"a\"]}' "
    "WHEN 2 THEN '{\"depth\": ' || (event_id % 12) || '}' WHEN 3 THEN '{\"loop_depth\": 3}' "
    "WHEN 4 THEN '{\"method_count\": 12, \"lines\": ' || event_id || ', \"method_names\": [\"m1\", \"m2\", \"m1\"]}' "
    "WHEN 5 THEN '{\"method_count\": 4}' WHEN 6 THEN '{\"element_count\": 31}' "
    "WHEN 7 THEN '{\"vuln_ids\": [\"V1\", \"V' || event_id || '\"]}' "
    "WHEN 8 THEN '{\"locations\": [{\"file_path\": \"l1\"}, {\"file_path\": \"l2\"}, {\"file_path\": \"l1\"}], "
    "\"instantiated_types\": [\"T1\"]}' ELSE '{\"target_path\": \"t' || (event_id % 4) || '\"}' END"
)
CTES["fnd"] = f"""
SELECT event_id::VARCHAR AS id, repository_id, repository_id || '-' || strftime(ts, '%Y-%m-%d') AS analysis_id,
       (['SECURITY', 'PERFORMANCE', 'DEPENDENCY', 'QUALITY'])[event_id % 4 + 1] AS category,
       ([{", ".join(f"'{x}'" for x in FINDING_TYPES)}])[event_id % {len(FINDING_TYPES)} + 1] AS type,
       CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM'
            WHEN 'view' THEN 'LOW' ELSE 'INFO' END AS severity, NULL::VARCHAR AS priority,
       'Finding ' || event_id AS title, 'why' AS explanation,
       CASE WHEN event_id % 3 = 0 THEN 'ev ' || event_id END AS evidence,
       CASE WHEN event_id % 2 = 0 THEN 'fix it' END AS suggested_fix, (floor(value)::BIGINT % 101)::INTEGER AS confidence,
       CASE WHEN event_id % 7 <> 0 THEN 'f' || (event_id % 50) END AS file_path,
       CASE WHEN event_id % 4 <> 1 THEN 'Sym' || (event_id % 13) END AS symbol_name,
       CASE WHEN event_id % 2 = 0 THEN (event_id % 9 + 1)::INTEGER END AS start_line,
       CASE WHEN event_id % 2 = 0 THEN (event_id % 9 + 3)::INTEGER END AS end_line,
       CASE WHEN event_id % 5 = 0 THEN ['f' || (event_id % 50), 'f' || (event_id % 31)] ELSE [] END AS related_files,
       {METADATA} AS metadata, ts AS created_at
FROM ev"""
CTES["ranked_severity"] = """
SELECT * FROM (VALUES ('INFO', 0, 0), ('LOW', 1, 1), ('MEDIUM', 2, 3), ('HIGH', 3, 6), ('CRITICAL', 4, 12))
  AS t(severity, rank, penalty)"""


def analyses(spark, sf) -> DataFrame:
    """One analysis per user and day, with scores taken from that day's events."""
    ev = events(spark, sf)
    day = F.date_format("ts", "yyyy-MM-dd")
    grouped = ev.groupBy("repository_id", day.alias("day")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.count("*").alias("n"),
        F.sum("event_id").alias("s"),
    )
    scores = {
        "overall": "s % 101", "architecture": "(s * 3) % 101", "security": "(s + n) % 101", "performance": "(s * 7) % 101",
        "maintainability": "CASE WHEN n % 4 = 0 THEN NULL ELSE (s + 11) % 101 END", "scalability": "(s + 23) % 101",
        "modularity": "CASE WHEN s % 5 = 0 THEN NULL ELSE s % 97 END", "layering": "(s * 5) % 101",
        "documentation": "(s + 31) % 101", "complexity": "(s * 2) % 101", "technical_debt": "(s + 57) % 101",
    }
    return grouped.select(
        F.concat("repository_id", F.lit("-"), "day").alias("id"), "repository_id",
        F.expr("CASE s % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END").alias("status"),
        *[F.expr(f"CAST({sql} AS int)").alias(f"{name}_score") for name, sql in scores.items()],
        "started_at", "completed_at",
    )


CTES["ana"] = """
SELECT repository_id || '-' || day AS id, repository_id,
       CASE s % 6 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
       (s % 101)::INTEGER AS overall_score, ((s * 3) % 101)::INTEGER AS architecture_score,
       ((s + n) % 101)::INTEGER AS security_score, ((s * 7) % 101)::INTEGER AS performance_score,
       (CASE WHEN n % 4 = 0 THEN NULL ELSE (s + 11) % 101 END)::INTEGER AS maintainability_score,
       ((s + 23) % 101)::INTEGER AS scalability_score,
       (CASE WHEN s % 5 = 0 THEN NULL ELSE s % 97 END)::INTEGER AS modularity_score,
       ((s * 5) % 101)::INTEGER AS layering_score, ((s + 31) % 101)::INTEGER AS documentation_score,
       ((s * 2) % 101)::INTEGER AS complexity_score, ((s + 57) % 101)::INTEGER AS technical_debt_score,
       started_at, completed_at
FROM (SELECT repository_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS started_at, max(ts) AS completed_at,
             count(*) AS n, sum(event_id)::BIGINT AS s FROM ev GROUP BY 1, 2)"""


# --- two versions of the documents ---------------------------------------------------

def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = document_files(spark, sf).withColumn("n", F.col("path").cast("bigint"))
    previous = docs.filter("n % 10 <> 0")
    current = docs.filter("n % 10 <> 1").withColumn(
        "content", F.when(F.col("n") % 7 == 0, F.replace("content", F.lit("e"), F.lit("E"))).otherwise(F.col("content")))
    keep = ["repository_id", "path", "content"]
    return tuple(
        df.select(*keep).withColumn("content_hash", tx.content_hash(F.col("content"))) for df in (previous, current)
    )


CTES["snap_prev"] = """
SELECT source AS repository_id, doc_id::VARCHAR AS path, text AS content, sha256(text) AS content_hash
FROM documents WHERE doc_id % 10 <> 0"""
CTES["snap_cur"] = """
SELECT repository_id, path, content, sha256(content) AS content_hash FROM (
  SELECT source AS repository_id, doc_id::VARCHAR AS path,
         CASE WHEN doc_id % 7 = 0 THEN replace(text, 'e', 'E') ELSE text END AS content FROM documents WHERE doc_id % 10 <> 1)"""
