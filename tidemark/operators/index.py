"""The code index: snapshots, symbols, edges, chunks, and their listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.containment import FILE, field_text
from tidemark.operators.keyed import top_per_key
from tidemark.schemas import require_columns

# Chunk limits, listing limits.
MAX_CHUNK_CHARS, OVERLAP_LINES = 8000, 5
SYMBOL_MATCHES, SYMBOL_SOURCE_CHARS = 5, 12_000
HEADING = r"^#{1,6}\s+.+$"

# Dependency markers per manifest group, and the keywords of the plain sniff.
FRAMEWORK_MARKERS = {
    ("requirements.txt", "pyproject.toml", "Pipfile"): {"fastapi": "FastAPI", "flask": "Flask", "django": "Django"},
    ("package.json",): {
        "next": "Next.js", "nuxt": "Nuxt", "@nestjs/core": "NestJS", "express": "Express", "koa": "Koa",
        "fastify": "Fastify", "react": "React", "vue": "Vue", "@angular/core": "Angular",
    },
    ("pom.xml", "build.gradle", "build.gradle.kts"): {
        "spring-boot": "Spring Boot", "org.springframework.boot": "Spring Boot", "quarkus": "Quarkus", "micronaut": "Micronaut",
    },
}
FRAMEWORK_KEYWORDS = ["react", "next", "express", "nestjs", "vue", "angular", "django", "flask", "fastapi", "spring"]

# Express method names and what a router object is called.
HTTP_METHODS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "all": "ANY"}
ROUTER_NAME = r"(?i)(router|app)$"

PATH = ["repository_id", "path"]


# --- snapshots ------------------------------------------------------------------------

def diff_snapshot(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repository_id, path, change): added, changed, deleted or same, by content hash.

    Only keys and hashes are shuffled.
    """
    old = previous.select(*PATH, F.col("content_hash").alias("_old"), F.lit(True).alias("_was"))
    new = current.select(*PATH, F.col("content_hash").alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed"))
    return old.join(new, PATH, "full_outer").select(*PATH, change.alias("change"))


def apply_snapshot(table: DataFrame, touched: DataFrame, new_rows: DataFrame, path: str = "path") -> DataFrame:
    """`table` without the rows of touched paths, plus `new_rows`."""
    gone = touched.select("repository_id", F.col("path").alias(path))
    return table.join(gone, ["repository_id", path], "left_anti").unionByName(new_rows)


def retract_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks without those named by `keys`: repositories, files or ids, by its columns."""
    return chunks.join(keys, keys.columns, "left_anti")


def with_embedding_status(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedding_status", F.when(F.col("embedding").isNotNull(), "EMBEDDED").otherwise("PENDING"))


# --- symbols and edges ----------------------------------------------------------------

def symbol_id(*parts: Column) -> Column:
    """Same symbol, same id on every run."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def flatten_symbols(nested: DataFrame) -> DataFrame:
    """Module, symbol and member rows of each parsed file, linked by parent id.

    `nested` has repository_id, path, doc_comment, line_count and `symbols`, an
    array of symbols that each hold `children`. Everything happens in the row.
    """
    def own(path: Column, kind: Column, name: Column, start: Column) -> Column:
        return symbol_id(F.col("repository_id"), path, kind, name, start)

    path = F.col("path")
    module_id = own(path, F.lit("MODULE"), path, F.lit(1))
    fields = ["kind", "name", "start_line", "end_line", "signature", "doc_comment", "decorators", "superclasses", "interfaces"]

    def row(symbol: Column, parent: Column) -> Column:
        return F.struct(
            own(path, symbol["kind"], symbol["name"], symbol["start_line"]).alias("id"), parent.alias("parent_id"),
            *[symbol[f].alias(f) for f in fields])

    tops = F.transform("symbols", lambda s: row(s, module_id))
    members = F.flatten(F.transform("symbols", lambda s: F.transform(
        s["children"], lambda c: row(c, own(path, s["kind"], s["name"], s["start_line"])))))
    none, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    module = F.struct(
        module_id.alias("id"), none.alias("parent_id"), F.lit("MODULE").alias("kind"), path.alias("name"),
        F.lit(1).alias("start_line"), F.greatest(F.col("line_count"), F.lit(1)).alias("end_line"), none.alias("signature"),
        F.col("doc_comment").alias("doc_comment"), names.alias("decorators"), none.alias("superclasses"), none.alias("interfaces"))
    return nested.select("repository_id", path.alias("file_path"), F.inline(F.concat(F.array(module), tops, members)))


def heritage_edges(symbols: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges from the base lists of classes and interfaces."""
    def listed(column: str, edge: str) -> Column:
        names = F.transform(F.split(F.coalesce(column, F.lit("")), ","), tx.strip)
        return F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(
            n.alias("target_package_name"), F.lit(edge).alias("edge_type")))

    both = F.concat(listed("superclasses", "EXTENDS"), listed("interfaces", "IMPLEMENTS"))
    return symbols.filter(F.col("kind").isin("CLASS", "INTERFACE")).select(
        "repository_id", F.col("id").alias("source_symbol_id"), "file_path", F.inline(both))


def attach_target_ids(edges: DataFrame, new_files: DataFrame, stored_files: DataFrame) -> DataFrame:
    """Edges with the id of their target file, from this run first, else as stored."""
    def ids(files: DataFrame, name: str) -> DataFrame:
        return files.select("repository_id", F.col("path").alias("target_file_path"), F.col("id").alias(name))

    key = ["repository_id", "target_file_path"]
    joined = edges.join(ids(new_files, "_new"), key, "left").join(ids(stored_files, "_stored"), key, "left")
    return joined.withColumn("target_file_id", F.coalesce("_new", "_stored")).drop("_new", "_stored")


def express_routes(ast: DataFrame) -> DataFrame:
    """Routes registered by calls like `router.get("/x")`."""
    objects = field_text(ast, "object", "_object").filter("_object_type = 'identifier'")
    objects = objects.filter(F.col("_object").rlike(ROUTER_NAME)).select(*FILE, F.col("node_id").alias("_member"))
    verbs = field_text(ast, "property", "_verb").select(*FILE, F.col("node_id").alias("_member"), F.lower("_verb").alias("_verb"))
    members = field_text(ast, "function", "_f").filter("_f_type = 'member_expression'").select(*FILE, "node_id", F.col("_f_id").alias("_member"))
    lists = ast.filter("field = 'arguments' AND parent_id IS NOT NULL").select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("node_id").alias("_list"))
    first = (
        ast.filter((F.col("parent_id").isNotNull()) & ~F.col("type").isin("(", ")", ","))
        .groupBy(*FILE, F.col("parent_id").alias("_list"))
        .agg(F.min(F.struct("pre", "type", "node_id", "text")).alias("_first")))
    fragments = ast.filter("type = 'string_fragment'").groupBy(*FILE, F.col("parent_id").alias("_string")).agg(
        F.min_by("text", "pre").alias("_fragment"))
    verb = F.coalesce(*[F.when(F.col("_verb") == name, F.lit(value)) for name, value in HTTP_METHODS.items()])
    routed = (
        ast.filter("type = 'call_expression'").select(*FILE, "node_id", "start_line")
        .join(members, [*FILE, "node_id"]).join(objects, [*FILE, "_member"]).join(verbs, [*FILE, "_member"])
        .join(lists, [*FILE, "node_id"]).join(first, [*FILE, "_list"]).filter("_first.type = 'string'")
        .withColumn("_string", F.col("_first.node_id")).join(fragments, [*FILE, "_string"], "left"))
    path = F.coalesce("_fragment", F.trim(F.col("_first.text"), F.lit("\"'`")))
    return routed.select(
        "repository_id", F.lit(None).cast("string").alias("symbol_id"), "file_path", verb.alias("method"), path.alias("path"),
        F.lit("Express").alias("framework"), "start_line").filter("method IS NOT NULL AND startswith(path, '/')")


# --- frameworks -----------------------------------------------------------------------

def _marker_pattern(marker: str) -> str:
    escaped = "".join("\\" + c if c in ".-/" else c for c in marker)
    # A scoped package starts with a sign no word boundary can precede: match the quoted key.
    return f"[\"']{escaped}[\"']" if marker.startswith("@") else rf"\b{escaped}\b"


def detect_frameworks(manifests: DataFrame, markers: dict[tuple[str, ...], dict[str, str]] = FRAMEWORK_MARKERS) -> DataFrame:
    """Sorted distinct framework names per repository."""
    text, name = F.lower("content"), F.element_at(F.split("path", "/"), -1)
    hits = F.array_compact(F.array(*[
        F.when(name.isin(*group) & text.rlike(_marker_pattern(marker)), F.lit(framework))
        for group, table in markers.items() for marker, framework in table.items()]))
    found = manifests.select("repository_id", F.explode_outer(hits).alias("framework"))
    return found.groupBy("repository_id").agg(F.sort_array(F.collect_set("framework")).alias("frameworks"))


def sniff_frameworks(manifests: DataFrame, keywords: Sequence[str] = FRAMEWORK_KEYWORDS) -> DataFrame:
    """Keywords that occur in any manifest of the repository, in list order."""
    text = F.lower("content")
    flags = manifests.groupBy("repository_id").agg(*[
        F.bool_or(F.contains(text, F.lit(word))).alias(f"_k{i}") for i, word in enumerate(keywords)])
    return flags.select("repository_id", F.array_compact(F.array(*[
        F.when(F.col(f"_k{i}"), F.lit(word)) for i, word in enumerate(keywords)])).alias("frameworks"))


# --- chunks ---------------------------------------------------------------------------

def _sized(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", tx.token_estimate(F.col("content")))


def module_chunks(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Per file its module comment and its import lines; none where both are empty.

    A file's imports are bounded by its size, so they are gathered per file.
    """
    names = F.array_join("imported_names", ", ")
    line = F.when(F.coalesce(F.size("imported_names"), F.lit(0)) > 0, F.concat(
        F.lit("from "), "module", F.lit(" import "), names)).otherwise(F.concat(F.lit("import "), "module"))
    lines = imports.select(*FILE, F.struct("position", line.alias("line")).alias("l")).groupBy(*FILE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("_lines"))
    docs = modules.select("repository_id", F.col("path").alias("file_path"), tx.non_empty(F.col("doc_comment")).alias("_doc"))
    content = F.concat_ws("\n\n", "_doc", "_lines")
    return _sized(docs.join(lines, FILE, "left").filter("_doc IS NOT NULL OR _lines IS NOT NULL").select(
        *FILE, F.lit("MODULE").alias("kind"), content.alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A class as its signature, comment and member signatures; others as their lines."""
    sources = files.select("repository_id", F.col("path").alias("file_path"), tx.text_lines(F.col("content")).alias("_source"))
    members = symbols.filter("parent_id IS NOT NULL").groupBy(*FILE, F.col("parent_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "signature"))),
                                 lambda m: F.concat(F.lit("    "), F.coalesce(m["signature"], F.lit("None")))), "\n").alias("_members"))
    # The lines of a symbol are cut out before its members join, so a file's text moves once.
    cut = symbols.filter("kind <> 'MODULE'").join(sources, FILE).withColumn(
        "_own", tx.line_slice(F.col("_source"), F.col("start_line"), F.col("end_line"))).drop("_source")
    joined = cut.join(members, [*FILE, "id"], "left")
    summary = F.concat_ws(
        "\n", F.coalesce(tx.non_empty(F.col("signature")), F.concat(F.lit("class "), "name")),
        F.when(F.coalesce("doc_comment", F.lit("")) != "", F.concat(F.lit('"""'), "doc_comment", F.lit('"""'))), "_members")
    chunks = joined.select(
        *FILE, F.col("id").alias("symbol_id"), "kind", F.when(F.col("kind") == "CLASS", summary).otherwise(F.col("_own")).alias("content"),
        "start_line")
    return split_oversized(chunks)


def is_markdown_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def section_chunks(docs: DataFrame, is_heading: Callable[[Column], Column] = is_markdown_heading) -> DataFrame:
    """One chunk per heading section; text before the first heading is a section.

    Sections are cut inside the document's own row, so nothing is shuffled.
    """
    require_columns(docs, "repository_id", "path", "content")
    lined = docs.select("repository_id", F.col("path").alias("file_path"), "content", tx.text_lines(F.col("content")).alias("_lines"))
    lines, starts, n = F.col("_lines"), F.col("_starts"), F.size("_lines")
    heads = F.filter(F.transform(lines, lambda line, i: F.when(is_heading(line), i)), lambda i: i.isNotNull())
    lead = F.concat(F.array(F.lit(0)), heads)
    marked = lined.withColumn("_heads", heads).withColumn("_starts", F.array_distinct(lead))
    sections = F.transform(starts, lambda s, k: F.struct(
        s.alias("start"), tx.strip(F.array_join(F.slice(
            lines, s + 1, F.coalesce(F.try_element_at(starts, k + 2), n) - s), "\n")).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("content").alias("text")))
    chosen = F.when(F.size("_heads") == 0, whole).otherwise(F.filter(sections, lambda s: s["text"] != ""))
    cut = marked.select("repository_id", "file_path", F.explode(chosen).alias("s")).select(
        "repository_id", "file_path", F.lit(None).cast("string").alias("symbol_id"), F.lit("DOCUMENTATION").alias("kind"),
        F.col("s.text").alias("content"), (F.col("s.start") + 1).alias("start_line"))
    return split_oversized(cut)


def _windows(text: Column, lines: Column, limit: int, overlap: int) -> Column:
    """(begin, length) of the line windows of a text whose breaks are all line feeds.

    Works on positions in the text: a window ends before the first line feed
    that is at least `limit` characters on, and the next one begins `overlap`
    lines earlier, but a line further than the last began. One fold, whose
    steps are idle once the text's end is reached.
    """
    def step(state: Column, _: Column) -> Column:
        begin = state["begin"]
        feed = F.call_function("locate", F.lit("\n"), text, begin + limit)
        length = F.when(feed > 0, feed - 1 - begin).otherwise(F.length(text) - begin)
        window = F.substring(text, begin + 1, length)
        tail = F.substring_index(window, "\n", -overlap)
        second = begin + F.length(F.substring_index(window, "\n", 1)) + 1
        following = F.when(F.length(tail) < length, feed - 1 - F.length(tail)).otherwise(second)
        moved = F.struct(
            F.when(feed > 0, following).otherwise(-1).cast("int").alias("begin"),
            F.array_append(state["found"], F.struct(begin.alias("begin"), length.cast("int").alias("length"))).alias("found"))
        return F.when(begin < 0, state).otherwise(moved)

    nothing = F.array().cast("array<struct<begin:int,length:int>>")
    return F.aggregate(F.sequence(F.lit(1), F.size(lines)), F.struct(F.lit(0).alias("begin"), nothing.alias("found")), step, lambda s: s["found"])


def split_oversized(chunks: DataFrame, limit: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Chunks over `limit` characters as line windows that overlap by `overlap` lines.

    Each chunk is cut within its own row by column expressions: one pass,
    nothing is shuffled and no Python runs.
    """
    names = [f.name for f in chunks.schema.fields if f.name not in ("content", "start_line")]

    def feeds(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    start = F.col("start_line").cast("int")
    big = F.length("content") > limit
    lined = chunks.select(*names, "content", start.alias("start_line"), F.when(big, tx.text_lines(F.col("content"))).alias("_lines"))
    plain = lined.withColumn("_text", F.array_join("_lines", "\n"))
    parts = F.transform(_windows(F.col("_text"), F.col("_lines"), limit, overlap), lambda w: F.struct(
        F.substring(F.col("_text"), w["begin"] + 1, w["length"]).alias("content"),
        (start + feeds(F.substring(F.col("_text"), F.lit(1), w["begin"]))).cast("int").alias("start_line")))
    whole = F.array(F.struct(F.col("content"), start.alias("start_line")))
    cut = plain.select(*names, F.inline(F.when(F.col("_lines").isNotNull(), parts).otherwise(whole)))
    return _sized(cut.select(*names, "content", "start_line", (F.col("start_line") + feeds(F.col("content"))).cast("int").alias("end_line")))


# --- listings -------------------------------------------------------------------------

def index_status(files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, symbols and chunks per repository; each side is counted before the join."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repository_id").agg(F.count("*").alias(name))

    joined = counted(files, "total_files")
    for df, name in ((symbols, "total_symbols"), (chunks, "total_chunks")):
        joined = joined.join(counted(df, name), "repository_id", "left")
    return joined.fillna(0)


def list_symbols(symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*kinds)).orderBy("repository_id", "start_line", "file_path", "id")


def find_symbols(symbols: DataFrame, name: str, kinds: Sequence[str], k: int = SYMBOL_MATCHES) -> DataFrame:
    """Per repository the first `k` symbols whose name contains `name`, ignoring case."""
    hits = symbols.filter(F.col("kind").isin(*kinds) & F.contains(F.lower("name"), F.lit(name.lower())))
    return top_per_key(hits, ["repository_id"], [F.col("file_path").asc(), F.col("start_line").asc(), F.col("id").asc()], k)


def symbol_source(symbols: DataFrame, files: DataFrame, limit: int = SYMBOL_SOURCE_CHARS) -> DataFrame:
    """Symbols with their source lines, cut at `limit` characters with a flag."""
    wanted = symbols.select(*FILE).distinct()
    sources = files.select("repository_id", F.col("path").alias("file_path"), F.split("content", "\n").alias("_lines")).join(
        wanted, FILE, "left_semi")
    joined = symbols.join(sources, FILE).withColumn("_all", tx.line_slice(F.col("_lines"), F.col("start_line"), F.col("end_line")))
    return joined.withColumn("source", tx.clip(F.col("_all"), limit)).withColumn(
        "truncated", F.length("_all") > limit).drop("_all", "_lines")


def list_files(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "path", "language", "lines_of_code").orderBy("repository_id", "path")
