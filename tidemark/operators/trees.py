"""Metrics and findings read from syntax trees.

`ast` holds one row per node with nested-set numbers. Node types play roles per
language; a role test is a plain IN list. All windows and joins are keyed by
file, and a file is at most a million bytes, so no task sees more than a file.

The shared inputs `functions`, `complexity` and the containment pairs are worth
persisting when several findings run over the same trees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.containment import FILE, children, contained, field_text, levels
from tidemark.operators.keyed import first_per_key, large_join, salted_join, top_per_key
from tidemark.operators.rules import finding_rows

Roles = Mapping[str, Mapping[str, Sequence[str]]]

# Which node types play which role, per language.
_SCRIPT_ROLES = {
    "decision": ["if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "catch_clause",
                 "switch_case", "ternary_expression"],
    "logical": ["&&", "||", "??"],
    "nesting": ["if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "try_statement",
                "switch_statement"],
    "loop": ["for_statement", "for_in_statement", "while_statement", "do_statement"],
    "call": ["call_expression"],
    "function": ["function_declaration", "method_definition", "arrow_function", "function_expression"],
}
NODE_ROLES: Roles = {
    "python": {
        "decision": ["if_statement", "elif_clause", "for_statement", "while_statement", "except_clause",
                     "conditional_expression", "case_clause"],
        "logical": ["and", "or"],
        "nesting": ["if_statement", "for_statement", "while_statement", "try_statement", "with_statement", "match_statement"],
        "loop": ["for_statement", "while_statement"],
        "call": ["call"],
        "function": ["function_definition"],
    },
    "javascript": _SCRIPT_ROLES,
    "typescript": _SCRIPT_ROLES,
    "java": {
        "decision": ["if_statement", "for_statement", "enhanced_for_statement", "while_statement", "do_statement",
                     "catch_clause", "switch_label", "ternary_expression"],
        "logical": ["&&", "||"],
        "nesting": ["if_statement", "for_statement", "enhanced_for_statement", "while_statement", "do_statement",
                    "try_statement", "switch_expression"],
        "loop": ["for_statement", "enhanced_for_statement", "while_statement", "do_statement"],
        "call": ["method_invocation"],
        "function": ["method_declaration", "constructor_declaration"],
    },
}

# Node types that mean the same in every language.
COMMON_ROLES = {
    "literal": ["dictionary", "list", "object", "array"],
    "pair": ["pair"],
    "branch": ["elif_clause", "switch_case", "case_clause", "switch_label"],
    "identifier": ["identifier", "property_identifier"],
}

# Leaf types counted as operands, and leaves that count as nothing.
OPERAND_TYPES = [
    "identifier", "property_identifier", "type_identifier", "field_identifier", "shorthand_property_identifier",
    "string", "string_content", "string_fragment", "number", "integer", "float", "decimal_integer_literal",
    "true", "false", "null", "none",
]
SKIPPED_LEAVES = ["(", ")", "{", "}", "[", "]", ",", ";", ":", ".", '"', "'", "`"]

# Names that mean a query, a membership scan, a blocking call, a cache, a getter.
QUERY_CALLEES = [
    "findOne", "findMany", "findById", "findUnique", "findFirst", "query", "execute", "fetchone", "fetchall", "get_or_create",
]
MEMBERSHIP_CALLEES = ["includes", "indexOf", "contains"]
BLOCKING_SUFFIX, BLOCKING_NAMES = "Sync", ["sleep"]
MEMO_WORDS = ["lru_cache", "cache", "memoize", "cached_property"]
GETTER_PREFIXES = ["get", "fetch", "load", "find"]
CONSTRUCTORS = ["__init__", "constructor"]
IGNORED_VARIABLES = ["_", "self", "this", "cls"]

# Thresholds of the findings.
MAX_COMPLEXITY, HIGH_COMPLEXITY = 10, 20
LONG_METHOD_LINES, VERY_LONG_METHOD_LINES = 50, 100
LARGE_CLASS_LINES, LARGE_CLASS_METHODS, HUGE_CLASS_LINES = 300, 15, 500
MAX_NESTING, MAX_LOOP_NESTING = 4, 2
LARGE_FILE_LINES, HUGE_FILE_LINES = 500, 1000
DUPLICATE_MIN_LINES = 5
LISTED_LOCATIONS = 20  # of a duplicate, on the finding itself
LARGE_LITERAL = 30
SRP_METHODS, SRP_LINES = 10, 200
OCP_ARMS = 4
ISP_TRIVIAL = 2

# What a trivial body line looks like, and comment openers.
TRIVIAL_BODY = (
    r"(?i)^(pass|\.\.\.|raise\s+NotImplementedError|throw\s+new\s+\w*Error|throw\s+new\s+UnsupportedOperationException)")
COMMENT_OPENERS = ["//", "#", "*", "/*"]

ANONYMOUS = "<anonymous>"
FUNCTION_ID = [*FILE, "function_id"]


def has_role(role: str, roles: Roles = NODE_ROLES) -> Column:
    """Whether the node's type plays `role` in its language."""
    test = F.lit(False)
    for language, table in roles.items():
        types = table.get(role, [])
        if types:
            test = test | ((F.col("language") == language) & F.col("type").isin(*types))
    if role in COMMON_ROLES:
        test = test | F.col("type").isin(*COMMON_ROLES[role])
    return test


# --- functions and calls --------------------------------------------------------------

def functions(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Function nodes with their name, span and source."""
    names = field_text(ast, "name", "_name").select(*FILE, "node_id", "_name")
    found = ast.filter(has_role("function", roles)).join(names, [*FILE, "node_id"], "left")
    return found.select(
        *FILE, "language", F.col("node_id").alias("function_id"), "pre", "post",
        F.coalesce("_name", F.lit(ANONYMOUS)).alias("function_name"), "start_line", "end_line", F.col("text").alias("function_text"))


def calls(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Call nodes with the name they call: the name field, else the attribute or
    property of the function field, else its text."""
    names = field_text(ast, "name", "_name").select(*FILE, "node_id", "_name")
    targets = field_text(ast, "function", "_function").select(*FILE, "node_id", "_function_id", "_function_type", "_function")
    parts = ast.filter(F.col("field").isin("attribute", "property") & F.col("parent_id").isNotNull()).groupBy(
        *FILE, F.col("parent_id").alias("_function_id")).agg(
        F.coalesce(F.first(F.when(F.col("field") == "attribute", F.col("text")), ignorenulls=True),
                   F.first(F.when(F.col("field") == "property", F.col("text")), ignorenulls=True)).alias("_part"))
    found = ast.filter(has_role("call", roles)).join(names, [*FILE, "node_id"], "left").join(
        targets, [*FILE, "node_id"], "left").join(parts, [*FILE, "_function_id"], "left")
    by_function = F.when(F.col("_function_type").isin("attribute", "member_expression"), F.col("_part")).otherwise(F.col("_function"))
    return found.withColumn("callee", F.coalesce("_name", by_function)).filter("callee IS NOT NULL").select(*ast.columns, "callee")


def _function_columns() -> dict[str, Column]:
    return {"function_id": F.col("node_id"), "function_pre": F.col("pre")}


def _in_functions(ast: DataFrame, inner: Column, inner_columns: Mapping[str, Column], roles: Roles) -> DataFrame:
    return contained(ast, has_role("function", roles), inner, _function_columns(), inner_columns)


def _named(pairs: DataFrame, ast: DataFrame, roles: Roles) -> DataFrame:
    info = functions(ast, roles).drop("pre", "post")
    return pairs.join(info, FUNCTION_ID)


# --- complexity and nesting -----------------------------------------------------------

def complexity(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """1 + decision nodes + logical operators inside each function, inner functions included."""
    operators = field_text(ast, "operator", "_operator").select(*FILE, "node_id", F.col("_operator_type").alias("_op"))
    told = has_role("decision", roles) | has_role("function", roles) | F.col("type").isin("boolean_operator", "binary_expression")
    joined = ast.filter(told).join(operators, [*FILE, "node_id"], "left")
    logical = F.lit(False)
    for language, table in roles.items():
        if table.get("logical"):
            logical = logical | ((F.col("language") == language) & F.col("_op").isin(*table["logical"]))
    is_logical = (F.col("type") == "boolean_operator") | ((F.col("type") == "binary_expression") & F.coalesce(logical, F.lit(False)))
    points = has_role("decision", roles).cast("int") + F.coalesce(is_logical, F.lit(False)).cast("int")
    scored = joined.withColumn("_points", points)
    pairs = _in_functions(scored, (F.col("_points") > 0) | has_role("function", roles), {"points": F.col("_points")}, roles)
    total = pairs.groupBy(*FUNCTION_ID).agg((F.sum("points") + 1).cast("int").alias("complexity"))
    return functions(ast, roles).join(total, FUNCTION_ID)


def _depth(ast: DataFrame, role: str, name: str, roles: Roles) -> DataFrame:
    """Greatest number of `role` nodes on a path strictly below each function."""
    flag = has_role(role, roles)
    leveled = levels(ast.filter(flag | has_role("function", roles)), {"nest": flag})
    pairs = contained(
        leveled, has_role("function", roles), flag | has_role("function", roles),
        {"function_id": F.col("node_id"), "_base": F.col("nest_level")},
        {"inner_id": F.col("node_id"), "_level": F.col("nest_level")})
    below = F.greatest(F.max(F.when(F.col("inner_id") != F.col("function_id"), F.col("_level") - F.col("_base"))), F.lit(0))
    depth = pairs.groupBy(*FUNCTION_ID).agg(below.cast("int").alias(name))
    return functions(ast, roles).join(depth, FUNCTION_ID)


def nesting_depth(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    return _depth(ast, "nesting", "depth", roles)


def loop_depth(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    return _depth(ast, "loop", "loop_depth", roles)


def fingerprint(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """sha256 of each function's node types in pre-order, joined by `|`."""
    pairs = _in_functions(ast, F.lit(True), {"_pre": F.col("pre"), "_type": F.col("type")}, roles)
    shape = F.transform(F.array_sort(F.collect_list(F.struct("_pre", "_type"))), lambda x: x["_type"])
    hashed = pairs.groupBy(*FUNCTION_ID).agg(F.sha2(F.array_join(shape, "|"), 256).alias("fingerprint"))
    return functions(ast, roles).join(hashed, FUNCTION_ID)


def halstead(ast: DataFrame) -> DataFrame:
    """Operators and operands per file, from leaf tokens: totals and distinct.

    Tokens are counted per (file, kind, token) first, so the distinct count is
    a plain count of rows and no Expand is needed.
    """
    inner = ast.filter("parent_id IS NOT NULL").select(*FILE, F.col("parent_id").alias("node_id")).distinct()
    leaves = ast.join(inner, [*FILE, "node_id"], "left_anti")
    operand = F.col("is_named") & F.col("type").isin(OPERAND_TYPES)
    operator = ~F.col("is_named") & ~F.col("type").isin(SKIPPED_LEAVES)
    kind = F.when(operand, "operand").when(operator, "operator")
    tokens = leaves.select(*FILE, kind.alias("kind"), F.when(operand, F.col("text")).otherwise(F.col("type")).alias("token"))
    counted = tokens.filter("kind IS NOT NULL").groupBy(*FILE, "kind", "token").agg(F.count("*").alias("n"))
    totals = counted.groupBy(*FILE).agg(*[
        expression for name in ("operator", "operand") for expression in (
            F.count_if(F.col("kind") == name).alias(f"distinct_{name}s"),
            F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(f"{name}s"))
    ])
    files = ast.select(*FILE).distinct()
    zero = {name: 0 for name in ("distinct_operators", "distinct_operands", "operators", "operands")}
    return files.join(totals, FILE, "left").fillna(zero)


def literal_sizes(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Elements directly in each literal: its pairs, else its named children."""
    literals = ast.filter(has_role("literal", roles)).select(
        *FILE, "language", "node_id", "pre", "post", "start_byte", "start_line", "end_line")
    kids = ast.select(
        *FILE, F.col("parent_id").alias("node_id"), has_role("pair", roles).alias("_pair"), "is_named").filter("node_id IS NOT NULL")
    counts = kids.groupBy(*FILE, "node_id").agg(
        F.count_if("_pair").alias("_pairs"), F.count_if("is_named").alias("_named"))
    elements = F.when(F.coalesce("_pairs", F.lit(0)) > 0, F.col("_pairs")).otherwise(F.coalesce("_named", F.lit(0)))
    return literals.join(counts, [*FILE, "node_id"], "left").withColumn("elements", elements).drop("_pairs", "_named")


# --- quality findings -----------------------------------------------------------------

def _tick(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _text(value) -> Column:
    return value.cast("string")


def high_complexity(measured: DataFrame, limit: int = MAX_COMPLEXITY, high: int = HIGH_COMPLEXITY) -> DataFrame:
    c = F.col("complexity")
    return finding_rows(
        measured.filter(c > limit), type="HIGH_COMPLEXITY", category="QUALITY", severity=F.when(c > high, "HIGH").otherwise("MEDIUM"),
        confidence=100, title=_tick("`", F.col("function_name"), "` has high cyclomatic complexity (", _text(c), ")"),
        symbol_name=F.col("function_name"), start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct("complexity")))


def long_method(found: DataFrame, limit: int = LONG_METHOD_LINES, high: int = VERY_LONG_METHOD_LINES) -> DataFrame:
    lines = F.col("end_line") - F.col("start_line") + 1
    return finding_rows(
        found.filter(lines > limit), type="LONG_METHOD", category="QUALITY", severity=F.when(lines > high, "HIGH").otherwise("MEDIUM"),
        confidence=100, title=_tick("`", F.col("function_name"), "` is a long method (", _text(lines), " lines)"),
        symbol_name=F.col("function_name"), start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct(lines.alias("lines"))))


def deep_nesting(measured: DataFrame, limit: int = MAX_NESTING) -> DataFrame:
    depth = F.col("depth")
    return finding_rows(
        measured.filter(depth > limit), type="DEEP_NESTING", category="QUALITY", severity="MEDIUM", confidence=100,
        title=_tick("`", F.col("function_name"), "` has deeply nested control flow (", _text(depth), " levels)"),
        symbol_name=F.col("function_name"), start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct("depth")))


def large_file(files: DataFrame, limit: int = LARGE_FILE_LINES, high: int = HUGE_FILE_LINES) -> DataFrame:
    lines = F.col("lines_of_code")
    return finding_rows(
        files.withColumn("file_path", F.col("path")).filter(lines > limit), type="LARGE_FILE", category="QUALITY",
        severity=F.when(lines > high, "MEDIUM").otherwise("LOW"), confidence=100,
        title=_tick(F.col("path"), " is a large file (", _text(lines), " lines)"), metadata=F.to_json(F.struct(lines.alias("lines"))))


def duplicates(fingerprints: DataFrame, min_lines: int = DUPLICATE_MIN_LINES) -> DataFrame:
    """One finding per repository and shape that several functions share.

    A shape may have any number of copies: the finding names the first
    `LISTED_LOCATIONS` and says whether there are more; `duplicate_locations`
    lists all, one row each.
    """
    long_enough = fingerprints.filter(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
    place = F.struct("file_path", "start_line", "end_line", "function_name")
    groups = long_enough.groupBy("repository_id", "fingerprint").agg(F.count("*").alias("members"), F.min(place).alias("_first"))
    firsts = top_per_key(long_enough, ["repository_id", "fingerprint"], [F.col(c).asc() for c in ("file_path", "start_line", "end_line", "function_id")],
                         LISTED_LOCATIONS)
    listed = firsts.groupBy("repository_id", "fingerprint").agg(F.array_sort(F.collect_list(F.struct(
        "file_path", "start_line", "end_line", F.col("function_name").alias("name")))).alias("locations"))
    anchored = groups.filter("members > 1").join(listed, ["repository_id", "fingerprint"]).withColumn(
        "truncated", F.col("members") > LISTED_LOCATIONS).select("repository_id", "fingerprint", "members", "locations", "truncated", F.col("_first.*"))
    rows = finding_rows(
        anchored, type="DUPLICATE_LOGIC", category="QUALITY", severity="MEDIUM", confidence=90,
        title=_tick("Duplicate logic found in ", _text(F.col("members")), " functions"), symbol_name=F.col("function_name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"), metadata=F.to_json(F.struct("fingerprint", "members", "locations", "truncated")))
    return rows


def duplicate_locations(fingerprints: DataFrame, min_lines: int = DUPLICATE_MIN_LINES) -> DataFrame:
    """Every function that shares its shape with another of its repository."""
    long_enough = fingerprints.filter(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
    shared = long_enough.groupBy("repository_id", "fingerprint").agg(F.count("*").alias("members")).filter("members > 1")
    return salted_join(long_enough, shared, ["repository_id", "fingerprint"], ["file_path", "function_id"]).select(
        "repository_id", "fingerprint", "members", "file_path", "function_name", "start_line", "end_line")


def unused_variables(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Locals bound by plain name that occur once in their function's text."""
    bindings = (("python", "assignment", "left"), ("javascript", "variable_declarator", "name"),
                ("typescript", "variable_declarator", "name"))
    binds = F.lit(False)
    bound = F.lit(False)
    for language, type_, field in bindings:
        same = F.col("language") == language
        binds = binds | (same & (F.col("type") == type_))
        bound = bound | (same & (F.col("field") == field) & (F.col("type") == "identifier"))
    assigning = ast.filter(binds).select(*FILE, "node_id", F.col("pre").alias("_site"))
    targets = ast.filter(bound & F.col("parent_id").isNotNull()).select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("text").alias("variable"),
        F.col("start_line").alias("line"), F.col("end_line").alias("last_line"))
    names = assigning.join(targets, [*FILE, "node_id"]).select(*FILE, "node_id", "variable", "line", "last_line")
    names = names.filter(~F.col("variable").isin(IGNORED_VARIABLES) & ~F.col("variable").startswith("_"))
    pairs = _in_functions(ast, binds, {"node_id": F.col("node_id")}, roles)
    hits = _named(pairs.join(names, [*FILE, "node_id"]), ast, roles)
    once = hits.filter(tx.word_hits(F.col("function_text"), F.col("variable")) <= 1)
    return finding_rows(
        once, type="UNUSED_VARIABLE", category="QUALITY", severity="LOW", confidence=75,
        title=_tick("Unused variable `", F.col("variable"), "` in `", F.col("function_name"), "`"),
        symbol_name=F.col("function_name"), start_line=F.col("line"), end_line=F.col("last_line"),
        metadata=F.to_json(F.struct(F.col("variable").alias("variable_name"))))


def unused_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imported names that occur at most once in their file."""
    name = F.element_at(F.split("imported", " as "), -1)
    bare = F.trim(F.element_at(F.split(name, r"\."), -1), F.lit("* "))
    named = (
        imports.select("repository_id", "file_path", "module", F.explode("imported_names").alias("imported"))
        .withColumn("name", bare).filter(F.col("name").rlike(r"(?U)^[\p{L}_]\w*$")))
    sources = files.select("repository_id", F.col("path").alias("file_path"), "content")
    once = named.join(sources, FILE).filter(tx.word_hits(F.col("content"), F.col("name")) <= 1)
    return finding_rows(
        once, type="UNUSED_IMPORT", category="QUALITY", severity="LOW", confidence=80,
        title=_tick("Unused import `", F.col("name"), "` in ", F.col("file_path")),
        metadata=F.to_json(F.struct(F.col("name").alias("import_name"), "module")))


# --- performance findings -------------------------------------------------------------

def _loop_calls(ast: DataFrame, callees: Sequence[str], roles: Roles) -> DataFrame:
    """(function, loop, call) for the named calls inside loops inside functions."""
    wanted = calls(ast, roles).filter(F.col("callee").isin(*callees)).select(*FILE, "node_id", "callee")
    marked = ast.filter(has_role("loop", roles) | has_role("call", roles)).join(wanted, [*FILE, "node_id"], "left")
    in_loops = contained(
        marked, has_role("loop", roles), F.col("callee").isNotNull(), {"loop_id": F.col("node_id")},
        {"call_id": F.col("node_id"), "call_pre": F.col("pre"), "callee": F.col("callee"),
         "call_line": F.col("start_line"), "call_end": F.col("end_line")})
    loops = _in_functions(
        ast, has_role("loop", roles), {"loop_id": F.col("node_id"), "loop_pre": F.col("pre"), "loop_line": F.col("start_line"),
                                       "loop_end": F.col("end_line")}, roles)
    return loops.join(in_loops, [*FILE, "loop_id"])


def n_plus_one(ast: DataFrame, roles: Roles = NODE_ROLES, callees: Sequence[str] = QUERY_CALLEES) -> DataFrame:
    """A query call inside a loop, once per loop and function, naming its first call."""
    hits = _loop_calls(ast, callees, roles)
    first = hits.groupBy(*FUNCTION_ID, "loop_id", "loop_line", "loop_end").agg(
        F.min_by("callee", "call_pre").alias("callee"))
    return finding_rows(
        _named(first, ast, roles), type="N_PLUS_ONE_QUERY", category="PERFORMANCE", severity="HIGH", confidence=60,
        title=_tick("Possible N+1 query in `", F.col("function_name"), "`"), symbol_name=F.col("function_name"),
        start_line=F.col("loop_line"), end_line=F.col("loop_end"), metadata=F.to_json(F.struct("callee")))


def blocking_calls(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Calls ending in Sync, or sleep, inside a function that starts with async."""
    wanted = calls(ast, roles).filter(F.col("callee").endswith(BLOCKING_SUFFIX) | F.col("callee").isin(BLOCKING_NAMES))
    marked = ast.filter(has_role("function", roles) | has_role("call", roles)).join(
        wanted.select(*FILE, "node_id", "callee"), [*FILE, "node_id"], "left")
    prefix = F.ltrim(F.substring("text", 1, 20))
    pairs = contained(
        marked, has_role("function", roles) & F.startswith(prefix, F.lit("async")), F.col("callee").isNotNull(), _function_columns(),
        {"callee": F.col("callee"), "call_line": F.col("start_line"), "call_end": F.col("end_line")})
    return finding_rows(
        _named(pairs, ast, roles), type="BLOCKING_OPERATION", category="PERFORMANCE", severity="MEDIUM", confidence=75,
        title=_tick("Blocking call `", F.col("callee"), "` inside async function `", F.col("function_name"), "`"),
        symbol_name=F.col("function_name"), start_line=F.col("call_line"), end_line=F.col("call_end"),
        metadata=F.to_json(F.struct("callee")))


def expensive_loops(measured: DataFrame, limit: int = MAX_LOOP_NESTING) -> DataFrame:
    depth = F.col("loop_depth")
    return finding_rows(
        measured.filter(depth > limit), type="EXPENSIVE_LOOP", category="PERFORMANCE", severity="MEDIUM", confidence=65,
        title=_tick("`", F.col("function_name"), "` has ", _text(depth), " nested loops"), symbol_name=F.col("function_name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"), metadata=F.to_json(F.struct("loop_depth")))


def large_literals(sizes: DataFrame, limit: int = LARGE_LITERAL) -> DataFrame:
    n = _text(F.col("elements"))
    return finding_rows(
        sizes.filter(F.col("elements") >= limit), type="LARGE_OBJECT", category="PERFORMANCE", severity="LOW", confidence=50,
        title=_tick("Large inline literal (", n, " elements) in ", F.col("file_path")), evidence=_tick(n, " inline elements"),
        start_line=F.col("start_line"), end_line=F.col("end_line"), metadata=F.to_json(F.struct(F.col("elements").alias("element_count"))))


def inefficient_collections(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Membership scans in loops: by call (40) and by Python's `in` (35)."""
    by_call = _named(_loop_calls(ast, MEMBERSHIP_CALLEES, roles), ast, roles).select(
        *FILE, "function_name", F.col("call_line").alias("line"), F.col("call_end").alias("last_line"),
        F.concat("callee", F.lit("() called inside a loop")).alias("evidence"), F.lit(40).alias("confidence"),
        F.to_json(F.struct("callee")).alias("metadata"))
    is_in = (F.col("language") == "python") & (F.col("type") == "comparison_operator")
    with_in = ast.filter((F.col("type") == "in") & F.col("parent_id").isNotNull()).select(
        *FILE, F.col("parent_id").alias("node_id")).distinct().withColumn("_has_in", F.lit(True))
    marked = ast.filter(has_role("loop", roles) | is_in).join(with_in, [*FILE, "node_id"], "left")
    in_loops = contained(
        marked, has_role("loop", roles), is_in & F.col("_has_in"), {"loop_id": F.col("node_id")},
        {"line": F.col("start_line"), "last_line": F.col("end_line")})
    loops = _in_functions(ast, has_role("loop", roles), {"loop_id": F.col("node_id")}, roles)
    by_operator = _named(loops.join(in_loops, [*FILE, "loop_id"]), ast, roles).select(
        *FILE, "function_name", "line", "last_line", F.lit("`in` operator used inside a loop").alias("evidence"),
        F.lit(35).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return finding_rows(
        by_call.unionByName(by_operator), type="INEFFICIENT_COLLECTION", category="PERFORMANCE", severity="LOW",
        confidence=F.col("confidence"), title=_tick("O(n) membership check inside a loop in `", F.col("function_name"), "`"),
        evidence=F.col("evidence"), symbol_name=F.col("function_name"), start_line=F.col("line"), end_line=F.col("last_line"),
        metadata=F.col("metadata"))


def unnecessary_objects(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Non-empty literals in a loop that share no identifier with the loop's header.

    Per function each literal is judged once, against the outermost loop around it.
    """
    is_loop, is_literal = has_role("loop", roles), has_role("literal", roles)
    loops = _in_functions(ast, is_loop, {"loop_id": F.col("node_id"), "loop_pre": F.col("pre")}, roles)
    literals = contained(
        ast, is_loop, is_literal, {"loop_id": F.col("node_id")},
        {"literal_id": F.col("node_id"), "literal_start": F.col("start_byte"), "line": F.col("start_line"), "last_line": F.col("end_line")})
    seen = loops.join(literals, [*FILE, "loop_id"])
    first = first_per_key(seen, [*FUNCTION_ID, "literal_start"], [F.col("loop_pre").asc(), F.col("literal_id").asc()])
    filled = literal_sizes(ast, roles).filter("elements > 0").select(*FILE, F.col("node_id").alias("literal_id"))
    first = first.join(filled, [*FILE, "literal_id"], "left_semi")
    # Identifiers of literals, and of loop headers: in the loop but not under its body child.
    is_name = F.col("type").isin(COMMON_ROLES["identifier"])
    name = {"name": F.col("text"), "name_id": F.col("node_id")}
    in_literal = contained(ast, is_literal, is_name, {"literal_id": F.col("node_id")}, name)
    in_loop = contained(ast, is_loop, is_name, {"loop_id": F.col("node_id")}, name)
    loop_ids = ast.filter(is_loop).select(*FILE, F.col("node_id").alias("loop_id"))
    bodies = ast.filter("field = 'body' AND parent_id IS NOT NULL").join(
        loop_ids, (ast["repository_id"] == loop_ids["repository_id"]) & (ast["file_path"] == loop_ids["file_path"])
        & (ast["parent_id"] == loop_ids["loop_id"]), "left_semi").select(*FILE, F.col("node_id").alias("_body"), F.lit(True).alias("_is_body"))
    marked = ast.filter(is_name | (F.col("field") == "body")).join(bodies.withColumnRenamed("_body", "node_id"), [*FILE, "node_id"], "left")
    in_body = contained(marked, F.col("_is_body"), is_name, {"loop_id": F.col("parent_id")}, {"name_id": F.col("node_id")})
    header = in_loop.join(in_body, [*FILE, "loop_id", "name_id"], "left_anti").select(*FILE, "loop_id", "name").distinct()
    shared = first.select(*FILE, "loop_id", "literal_id").distinct().join(
        in_literal.select(*FILE, "literal_id", "name").distinct(), [*FILE, "literal_id"]).join(
        header, [*FILE, "loop_id", "name"], "left_semi")
    free = first.join(shared.select(*FILE, "loop_id", "literal_id").distinct(), [*FILE, "loop_id", "literal_id"], "left_anti")
    return finding_rows(
        _named(free, ast, roles), type="UNNECESSARY_OBJECT_CREATION", category="PERFORMANCE", severity="LOW", confidence=35,
        title=_tick("Object/array literal re-created every iteration in `", F.col("function_name"), "`"),
        evidence=F.lit("Literal recreated each iteration, doesn't depend on the loop variable"),
        symbol_name=F.col("function_name"), start_line=F.col("line"), end_line=F.col("last_line"))


def parameter_counts(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Named children of each function's `parameters` child."""
    lists = ast.filter("field = 'parameters' AND parent_id IS NOT NULL").select(
        *FILE, "node_id", F.col("parent_id").alias("function_id"))
    return children(ast, lists).groupBy(*FUNCTION_ID).agg(F.count_if("child_is_named").alias("parameters"))


def missing_caching(ast: DataFrame, files: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Getters with at most one parameter that query, in files that never mention a cache."""
    mentions = F.lit(False)
    for word in MEMO_WORDS:
        mentions = mentions | F.contains("content", F.lit(word))
    plain = files.filter(~mentions).select("repository_id", F.col("path").alias("file_path"))
    queries = calls(ast, roles).filter(F.col("callee").isin(QUERY_CALLEES)).select(*FILE, "node_id", "callee")
    marked = ast.filter(has_role("function", roles) | has_role("call", roles)).join(queries, [*FILE, "node_id"], "left")
    pairs = contained(marked, has_role("function", roles), F.col("callee").isNotNull(), _function_columns(),
                      {"callee": F.col("callee"), "call_pre": F.col("pre")})
    heavy = pairs.groupBy(*FUNCTION_ID).agg(F.min_by("callee", "call_pre").alias("callee"))
    lowered = F.lower("function_name")
    getter = F.lit(False)
    for prefix in GETTER_PREFIXES:
        getter = getter | lowered.startswith(prefix)
    found = _named(heavy, ast, roles).filter(getter).join(plain, FILE, "left_semi").join(
        parameter_counts(ast, roles), FUNCTION_ID, "left").filter(F.coalesce("parameters", F.lit(0)) <= 1)
    return finding_rows(
        found, type="MISSING_CACHING", category="PERFORMANCE", severity="LOW", confidence=30,
        title=_tick("`", F.col("function_name"), "` may benefit from caching"),
        evidence=_tick("Getter-style function calling ", F.col("callee"), "(), no memoization found in file"),
        symbol_name=F.col("function_name"), start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct("callee", F.coalesce("parameters", F.lit(0)).alias("parameters"))))


def heavy_queries(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    """Query calls without any argument."""
    queries = calls(ast, roles).filter(F.col("callee").isin(QUERY_CALLEES))
    lists = ast.filter("field = 'arguments' AND parent_id IS NOT NULL").select(
        *FILE, "node_id", F.col("parent_id").alias("_call"))
    argued = children(ast, lists).filter("child_is_named").select(*FILE, F.col("_call").alias("node_id")).distinct()
    bare = queries.join(argued, [*FILE, "node_id"], "left_anti")
    return finding_rows(
        bare, type="HEAVY_DATABASE_CALL", category="PERFORMANCE", severity="MEDIUM", confidence=45,
        title=_tick("`", F.col("callee"), "()` called with no filter/limit in ", F.col("file_path")),
        evidence=F.concat("callee", F.lit("() called with zero arguments")), start_line=F.col("start_line"),
        end_line=F.col("end_line"), metadata=F.to_json(F.struct("callee")))


# --- design candidates ----------------------------------------------------------------

def class_sizes(symbols: DataFrame) -> DataFrame:
    """Classes with their line span and number of methods."""
    methods = symbols.filter("kind = 'METHOD'").groupBy("repository_id", "file_path", F.col("parent_id").alias("id")).agg(
        F.count("*").alias("methods"))
    classes = symbols.filter("kind = 'CLASS'").join(methods, ["repository_id", "file_path", "id"], "left")
    return classes.withColumn("methods", F.coalesce("methods", F.lit(0))).withColumn(
        "lines", F.col("end_line") - F.col("start_line") + 1)


def large_classes(
    sizes: DataFrame, lines: int = LARGE_CLASS_LINES, methods: int = LARGE_CLASS_METHODS, huge: int = HUGE_CLASS_LINES,
) -> DataFrame:
    big = sizes.filter((F.col("lines") > lines) | (F.col("methods") > methods))
    return finding_rows(
        big, type="LARGE_CLASS", category="QUALITY", severity=F.when(F.col("lines") <= huge, "MEDIUM").otherwise("HIGH"),
        confidence=100, title=_tick("`", F.col("name"), "` is a large class (", _text(F.col("lines")), " lines, ",
                                    _text(F.col("methods")), " methods)"),
        symbol_name=F.col("name"), start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct("lines", F.col("methods").alias("method_count"))))


def srp_candidates(sizes: DataFrame, methods: int = SRP_METHODS, lines: int = SRP_LINES) -> DataFrame:
    wide = sizes.filter((F.col("methods") >= methods) & (F.col("lines") >= lines))
    return finding_rows(
        wide, type="SRP_CANDIDATE", category="SOLID", severity="MEDIUM", confidence=40,
        title=_tick("`", F.col("name"), "` may violate the Single Responsibility Principle"), symbol_name=F.col("name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct(F.col("methods").alias("method_count"), "lines")))


def dip_candidates(ast: DataFrame, roles: Roles = NODE_ROLES, constructors: Sequence[str] = CONSTRUCTORS) -> DataFrame:
    """Constructors that instantiate types: `new`, object creation, or a call of a capitalised name."""
    kinds = (
        (["javascript", "typescript"], "new_expression", "constructor"),
        (["java"], "object_creation_expression", "type"),
        (["python"], "call", "function"),
    )
    creates, names = F.lit(False), F.lit(False)
    for languages, type_, field in kinds:
        same = F.col("language").isin(*languages)
        creates = creates | (same & (F.col("type") == type_))
        name = same & (F.col("field") == field)
        if "python" in languages:
            name = name & (F.col("type") == "identifier") & F.col("text").rlike(r"^\p{Lu}")
        names = names | name
    made = ast.filter(names & F.col("parent_id").isNotNull()).select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("text").alias("created"))
    marked = ast.filter(creates | has_role("function", roles)).join(made, [*FILE, "node_id"], "left")
    pairs = _in_functions(marked, creates & F.col("created").isNotNull(), {"_pre": F.col("pre"), "created": F.col("created")}, roles)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pre", "created"))), lambda x: x["created"])
    found = _named(pairs.groupBy(*FUNCTION_ID).agg(ordered.alias("types")), ast, roles).filter(
        F.col("function_name").isin(*constructors))
    return finding_rows(
        found, type="DIP_CANDIDATE", category="SOLID", severity="LOW", confidence=40,
        title=_tick("`", F.col("function_name"), "` directly instantiates concrete dependencies"), symbol_name=F.col("function_name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct(F.col("types").alias("instantiated_types"))))


def branch_arms(ast: DataFrame, roles: Roles = NODE_ROLES) -> DataFrame:
    is_branch = has_role("branch", roles)
    pairs = _in_functions(ast, is_branch, {"_pre": F.col("pre")}, roles)
    return _named(pairs.groupBy(*FUNCTION_ID).agg(F.count("*").cast("int").alias("arms")), ast, roles)


def ocp_candidates(counted: DataFrame, limit: int = OCP_ARMS) -> DataFrame:
    arms = _text(F.col("arms"))
    return finding_rows(
        counted.filter(F.col("arms") >= limit), type="OCP_CANDIDATE", category="SOLID", severity="LOW", confidence=35,
        title=_tick("`", F.col("function_name"), "` has a ", arms, "-way branch that may violate the Open/Closed Principle"),
        evidence=_tick(arms, " branch arms in one function"), symbol_name=F.col("function_name"),
        start_line=F.col("start_line"), end_line=F.col("end_line"), metadata=F.to_json(F.struct(F.col("arms").alias("branch_count"))))


def trivial_body(lines: Column, start_line: Column, end_line: Column) -> Column:
    """One or two body lines that are not comments, one of them pass, raise or throw."""
    span = F.greatest(F.least(end_line - 1, F.size(lines)) - start_line, F.lit(0))
    body = F.transform(F.slice(lines, start_line + 1, span), tx.strip)
    comment = "^(" + "|".join("\\Q" + opener + "\\E" for opener in COMMENT_OPENERS) + ")"
    told = F.filter(body, lambda line: (line != "") & ~line.rlike(comment))
    return F.size(told).between(1, 2) & F.exists(told, lambda line: line.rlike(TRIVIAL_BODY))


def trivial_methods(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Methods whose body only passes, raises or throws."""
    sources = files.select(
        "repository_id", F.col("path").alias("file_path"), tx.text_lines(F.col("content")).alias("_lines"))
    methods = large_join(symbols.filter("kind = 'METHOD'"), sources, FILE)
    return methods.filter(trivial_body(F.col("_lines"), F.col("start_line"), F.col("end_line"))).drop("_lines")


def _owners(symbols: DataFrame, column: str) -> DataFrame:
    filled = F.coalesce(F.col(column), F.lit("")) != ""
    return symbols.filter((F.col("kind") == "CLASS") & filled).select(
        *FILE, F.col("id").alias("parent_id"), F.col("name").alias("class_name"), F.col(column).alias("bases"),
        F.col("start_line").alias("class_start"), F.col("end_line").alias("class_end"))


def lsp_candidates(trivial: DataFrame, symbols: DataFrame) -> DataFrame:
    """Trivial methods of classes that have superclasses."""
    hits = large_join(trivial, _owners(symbols, "superclasses"), [*FILE, "parent_id"])
    name = F.concat("class_name", F.lit("."), "name")
    return finding_rows(
        hits, type="LSP_CANDIDATE", category="SOLID", severity="MEDIUM", confidence=40,
        title=_tick("`", name, "` may violate the Liskov Substitution Principle"), evidence=F.lit("Method body only raises/throws"),
        symbol_name=name, start_line=F.col("start_line"), end_line=F.col("end_line"),
        metadata=F.to_json(F.struct("class_name", F.col("name").alias("method_name"), F.col("bases").alias("superclass"))))


def isp_candidates(trivial: DataFrame, symbols: DataFrame, limit: int = ISP_TRIVIAL) -> DataFrame:
    """Classes with interfaces and at least two trivial methods."""
    hits = large_join(trivial, _owners(symbols, "interfaces"), [*FILE, "parent_id"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda m: m["name"])
    grouped = hits.groupBy(*FILE, "parent_id", "class_name", "bases", "class_start", "class_end").agg(names.alias("methods"))
    wide = grouped.filter(F.size("methods") >= limit)
    return finding_rows(
        wide, type="ISP_CANDIDATE", category="SOLID", severity="LOW", confidence=35,
        title=_tick("`", F.col("class_name"), "` may violate the Interface Segregation Principle"),
        evidence=_tick(_text(F.size("methods")), " trivial/empty method implementations"), symbol_name=F.col("class_name"),
        start_line=F.col("class_start"), end_line=F.col("class_end"),
        metadata=F.to_json(F.struct(F.col("bases").alias("interfaces"), F.col("methods").alias("trivial_methods"))))
