"""Symbols, imports, decorators, comments and signatures read out of syntax trees.

The trees arrive as rows; parsing a file into one is not done here. Every join
is between nodes of one file, on (repository_id, file_path, node id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.containment import FILE, children, field_text

NODE = [*FILE, "node_id"]

# Node types of symbols per language, and what wraps them.
FUNCTION_TYPES = {"python": ["function_definition"], "javascript": ["function_declaration"], "typescript": ["function_declaration"], "java": []}
CLASS_TYPES = {"python": ["class_definition"], "javascript": ["class_declaration"], "typescript": ["class_declaration"], "java": ["class_declaration"]}
INTERFACE_TYPES = {"python": [], "javascript": ["interface_declaration"], "typescript": ["interface_declaration"], "java": ["interface_declaration"]}
METHOD_TYPES = {"python": ["function_definition"], "javascript": ["method_definition"], "typescript": ["method_definition"],
                "java": ["method_declaration", "constructor_declaration"]}
WRAPPERS = {"decorated_definition": "definition", "export_statement": "declaration"}
DECLARATIONS = ["lexical_declaration", "variable_declaration"]
FUNCTION_VALUES = ["arrow_function", "function_expression"]
COMMENT_TYPES = ["comment", "block_comment", "line_comment"]
SIGNATURE_TAIL = {"python": r"[: \n\t]+$", "javascript": r"[{ \n\t]+$", "typescript": r"[{ \n\t]+$", "java": r"[{; \n\t]+$"}


def _typed(table: dict[str, list[str]]) -> Column:
    test = F.lit(False)
    for language, types in table.items():
        if types:
            test = test | ((F.col("language") == language) & F.col("type").isin(*types))
    return test


def _kind() -> Column:
    return F.when(_typed(FUNCTION_TYPES), "FUNCTION").when(_typed(CLASS_TYPES), "CLASS").when(_typed(INTERFACE_TYPES), "INTERFACE")


def _unwrapped(ast: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of `parents`, with the wrapped node in place of a wrapper.

    Adds `anchor_id`, the child itself, to which comments and decorators attach.
    """
    owners = parents.select(*FILE, F.col("node_id").alias("parent_id"), *[c for c in parents.columns if c not in (*FILE, "node_id")])
    direct = ast.join(owners, [*FILE, "parent_id"]).withColumn("anchor_id", F.col("node_id"))
    wraps = F.lit(False)
    for wrapper, field in WRAPPERS.items():
        wraps = wraps | ((F.col("_wrapper") == wrapper) & (F.col("field") == field))
    extra = [c for c in parents.columns if c not in (*FILE, "node_id")]
    outer = direct.filter(F.col("type").isin(list(WRAPPERS))).select(
        *FILE, F.col("node_id").alias("parent_id"), F.col("type").alias("_wrapper"), "anchor_id", *extra)
    inner = ast.join(outer, [*FILE, "parent_id"]).filter(wraps).drop("_wrapper")
    return direct.filter(~F.col("type").isin(list(WRAPPERS))).unionByName(inner)


def _roots(ast: DataFrame) -> DataFrame:
    return ast.filter("parent_id IS NULL").select(*NODE)


def _names(ast: DataFrame) -> DataFrame:
    return field_text(ast, "name", "_name").select(*NODE, "_name")


def top_symbols(ast: DataFrame) -> DataFrame:
    """Functions, classes and interfaces at the top of each file.

    Looks through decorators and exports. A script variable bound to a
    function counts as one, spanning its declaration.
    """
    tops = _unwrapped(ast, _roots(ast))
    declared = tops.withColumn("kind", _kind()).filter("kind IS NOT NULL").join(_names(ast), NODE, "left").select(
        *NODE, "anchor_id", "language", "kind", F.coalesce("_name", F.lit("<anonymous>")).alias("name"), "start_line", "end_line", "pre")
    statements = tops.filter(F.col("type").isin(DECLARATIONS)).select(
        *NODE, "anchor_id", F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    owners = statements.withColumnRenamed("node_id", "parent_id")
    declarators = ast.filter("type = 'variable_declarator'").join(owners, [*FILE, "parent_id"])
    values = field_text(ast, "value", "_value").filter(F.col("_value_type").isin(FUNCTION_VALUES)).select(*NODE)
    bound = declarators.join(values, NODE, "left_semi").join(_names(ast), NODE, "left").select(
        *NODE, "anchor_id", "language", F.lit("FUNCTION").alias("kind"), F.coalesce("_name", F.lit("<anonymous>")).alias("name"),
        F.col("_start").alias("start_line"), F.col("_end").alias("end_line"), "pre")
    return declared.unionByName(bound)


def methods(ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """Direct members of class bodies; for Java also constructors and interface methods."""
    owners = symbols.filter((F.col("kind") == "CLASS") | ((F.col("kind") == "INTERFACE") & (F.col("language") == "java")))
    owners = owners.select(*FILE, F.col("node_id").alias("parent_id"), F.col("kind").alias("_owner_kind"))
    bodies = ast.filter("field = 'body'").join(owners, [*FILE, "parent_id"]).select(
        *NODE, F.col("parent_id").alias("class_id"), "_owner_kind")
    is_method = _typed(METHOD_TYPES) & ((F.col("_owner_kind") == "CLASS") | (F.col("type") == "method_declaration"))
    return _unwrapped(ast, bodies).filter(is_method).join(_names(ast), NODE, "left").select(
        *NODE, "anchor_id", "class_id", "language", F.lit("METHOD").alias("kind"), F.coalesce("_name", F.lit("<anonymous>")).alias("name"),
        "start_line", "end_line", "pre")


# --- imports --------------------------------------------------------------------------

def _listed(rows: DataFrame) -> DataFrame:
    """(file, import node, module, ordered names) from rows of one name each; a null name only keeps the import."""
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_at", "_name")))), lambda x: x["_name"])
    return rows.groupBy(*NODE, "language", "pre", "module").agg(names.alias("imported_names"))


def _python_imports(ast: DataFrame, aliased: bool) -> DataFrame:
    nodes = ast.filter("language = 'python'").join(
        _roots(ast).select(*FILE, F.col("node_id").alias("parent_id")), [*FILE, "parent_id"], "left_semi")
    plain = children(ast.filter("type IN ('dotted_name', 'aliased_import')"), nodes.filter("type = 'import_statement'").select(
        *NODE, "language", "pre"), "c_")
    direct = plain.filter("c_type = 'dotted_name'").select(
        *FILE, F.col("c_id").alias("node_id"), "language", F.col("c_pre").alias("pre"), F.col("c_text").alias("module"))
    if aliased:
        holders = plain.filter("c_type = 'aliased_import'").select(*FILE, F.col("c_id").alias("node_id"), "language")
        inner = children(ast, holders, "n_").filter("n_type = 'dotted_name'").select(
            *FILE, F.col("n_id").alias("node_id"), "language", F.col("n_pre").alias("pre"), F.col("n_text").alias("module"))
        direct = direct.unionByName(inner)
    whole = direct.withColumn("imported_names", F.array().cast("array<string>"))
    told = ast.filter("type IN ('relative_import', 'dotted_name', 'aliased_import', 'wildcard_import')")
    froms = children(told, nodes.filter("type = 'import_from_statement'").select(*NODE, "language", "pre"), "c_")
    first = Window.partitionBy(*NODE)
    is_module = F.col("c_type").isin("relative_import", "dotted_name")
    placed = froms.withColumn("_module_pre", F.min(F.when(is_module, F.col("c_pre"))).over(first)).withColumn(
        "module", F.min(F.when(F.col("c_pre") == F.col("_module_pre"), F.col("c_text"))).over(first))
    name = F.when(F.col("c_pre") != F.col("_module_pre"), F.when(F.col("c_type").isin("dotted_name", "aliased_import"), F.col("c_text")).when(
        F.col("c_type") == "wildcard_import", F.lit("*")))
    named = _listed(placed.filter("module IS NOT NULL").select(
        *NODE, "language", "pre", "module", name.alias("_name"), F.col("c_pre").alias("_at")))
    return whole.select(*NODE, "language", "pre", "module", "imported_names").unionByName(named)


def _string_values(ast: DataFrame) -> DataFrame:
    """(file, string node, its value): the fragment, else the text without quotes."""
    fragments = ast.filter("type = 'string_fragment'").groupBy(*FILE, F.col("parent_id").alias("node_id")).agg(
        F.min_by("text", "pre").alias("_fragment"))
    return ast.filter("type = 'string'").join(fragments, NODE, "left").select(
        *NODE, F.coalesce("_fragment", F.trim(F.col("text"), F.lit("\"'`"))).alias("value"))


def _script_imports(ast: DataFrame) -> DataFrame:
    scripts = F.col("language").isin("javascript", "typescript")
    tops = _unwrapped(ast, _roots(ast)).filter(scripts)
    strings = _string_values(ast)
    sources = ast.filter("field = 'source'").select(*FILE, F.col("parent_id").alias("_import"), "node_id").join(strings, NODE).select(
        *FILE, F.col("_import").alias("node_id"), F.col("value").alias("module"))
    statements = tops.filter("type = 'import_statement'").select(*NODE, "language", "pre").join(sources, NODE)
    clause = children(ast, statements, "c_").filter("c_type = 'import_clause'").select(
        *NODE, "language", "pre", "module", F.col("c_id").alias("_clause"))
    named = ast.filter("type IN ('identifier', 'namespace_import', 'named_imports')")
    parts = children(named, clause.select(*FILE, F.col("_clause").alias("node_id"), F.col("node_id").alias("_import"), "language", "pre", "module"), "p_")
    key = [*FILE, F.col("_import").alias("node_id"), "language", "pre", "module"]
    defaults = parts.filter("p_type = 'identifier'").select(*key, F.col("p_text").alias("_name"), F.col("p_pre").alias("_at"))
    spaces = children(ast.filter("type = 'identifier'"), parts.filter("p_type = 'namespace_import'").select(
        *FILE, F.col("p_id").alias("node_id"), "_import", "language", "pre", "module", F.col("p_pre").alias("_at")), "n_")
    last = spaces.groupBy(*NODE, "_import", "language", "pre", "module", "_at").agg(F.max_by("n_text", "n_pre").alias("_last"))
    spaces = last.select(*key, F.concat(F.lit("* as "), "_last").alias("_name"), "_at")
    lists = children(ast, parts.filter("p_type = 'named_imports'").select(
        *FILE, F.col("p_id").alias("node_id"), "_import", "language", "pre", "module"), "s_").filter("s_type = 'import_specifier'")
    alias = field_text(ast, "alias", "_alias").select(*FILE, F.col("node_id").alias("s_id"), "_alias")
    name = field_text(ast, "name", "_orig").select(*FILE, F.col("node_id").alias("s_id"), "_orig")
    specs = lists.join(name, [*FILE, "s_id"]).join(alias, [*FILE, "s_id"], "left").select(
        *key, F.concat_ws(" as ", "_orig", "_alias").alias("_name"), F.col("s_pre").alias("_at"))
    bare = statements.select(*NODE, "language", "pre", "module", F.lit(None).cast("string").alias("_name"), F.lit(0).alias("_at"))
    imported = _listed(bare.unionByName(defaults).unionByName(spaces).unionByName(specs))
    return imported.unionByName(_requires(ast, tops, strings))


def _requires(ast: DataFrame, tops: DataFrame, strings: DataFrame) -> DataFrame:
    """`const x = require("y")`, plain or destructured."""
    owners = tops.filter(F.col("type").isin(DECLARATIONS)).select(*FILE, F.col("node_id").alias("parent_id"))
    declarators = ast.filter("type = 'variable_declarator'").join(owners, [*FILE, "parent_id"], "left_semi").select(*NODE, "language", "pre")
    values = field_text(ast, "value", "_v").filter("_v_type = 'call_expression'").select(*NODE, "_v_id")
    called = field_text(ast, "function", "_f").filter("_f = 'require'").select(*FILE, F.col("node_id").alias("_v_id"))
    lists = ast.filter("field = 'arguments'").select(*FILE, F.col("parent_id").alias("_v_id"), F.col("node_id").alias("_list"))
    first = ast.filter("type = 'string'").groupBy(*FILE, F.col("parent_id").alias("_list")).agg(F.min_by("node_id", "pre").alias("_string"))
    modules = (
        declarators.join(values, NODE).join(called, [*FILE, "_v_id"], "left_semi").join(lists, [*FILE, "_v_id"])
        .join(first, [*FILE, "_list"])
        .join(strings.select(*FILE, F.col("node_id").alias("_string"), F.col("value").alias("module")), [*FILE, "_string"])
        .select(*NODE, "language", "pre", "module"))
    targets = field_text(ast, "name", "_t").select(*NODE, "_t_id", "_t_type", "_t")
    aimed = modules.join(targets, NODE, "left")
    plain = aimed.select(
        *NODE, "language", "pre", "module", F.when(F.col("_t_type") == "identifier", F.col("_t")).alias("_name"), F.lit(0).alias("_at"))
    pattern = aimed.filter("_t_type = 'object_pattern'").select(
        *FILE, F.col("_t_id").alias("node_id"), F.col("node_id").alias("_import"), "language", "pre", "module")
    parts = children(ast.filter("type IN ('shorthand_property_identifier_pattern', 'pair_pattern')"), pattern, "p_")
    keys = field_text(ast, "key", "_key").select(*FILE, F.col("node_id").alias("p_id"), "_key")
    name = F.when(F.col("p_type") == "shorthand_property_identifier_pattern", F.col("p_text")).when(
        F.col("p_type") == "pair_pattern", F.col("_key"))
    taken = parts.join(keys, [*FILE, "p_id"], "left").select(
        *FILE, F.col("_import").alias("node_id"), "language", "pre", "module", name.alias("_name"), F.col("p_pre").alias("_at"))
    return _listed(plain.unionByName(taken))


def _java_imports(ast: DataFrame) -> DataFrame:
    nodes = ast.filter("language = 'java' AND type = 'import_declaration'").join(
        _roots(ast).select(*FILE, F.col("node_id").alias("parent_id")), [*FILE, "parent_id"], "left_semi").select(*NODE, "language", "pre")
    parts = children(ast.filter("type IN ('scoped_identifier', 'identifier', 'asterisk')"), nodes, "c_")
    named = F.col("c_type").isin("scoped_identifier", "identifier")
    grouped = parts.groupBy(*NODE, "language", "pre").agg(
        F.min_by(F.when(named, F.col("c_text")), F.when(named, F.col("c_pre"))).alias("_module"),
        F.bool_or(F.col("c_type") == "asterisk").alias("_all"))
    module = F.when(F.col("_all"), F.concat("_module", F.lit(".*"))).otherwise(F.col("_module"))
    return grouped.filter("_module IS NOT NULL").select(
        *NODE, "language", "pre", module.alias("module"), F.array().cast("array<string>").alias("imported_names"))


def imports(ast: DataFrame, aliased_modules: bool = True) -> DataFrame:
    """All imports of each file, numbered in source order.

    `aliased_modules` also reads Python's `import a as b`.
    """
    found = _python_imports(ast, aliased_modules).unionByName(_script_imports(ast)).unionByName(_java_imports(ast))
    place = F.row_number().over(Window.partitionBy(*FILE).orderBy("pre", "node_id"))
    return found.withColumn("position", place).select(*FILE, "language", "position", "module", "imported_names")


# --- decorators, comments, heritage, signatures ---------------------------------------

def _leading_run(kids: DataFrame, type_: str, key: list[str], prefix: str) -> DataFrame:
    """The unbroken run of `type_` children from the first child on, as texts."""
    order = Window.partitionBy(*key).orderBy(f"{prefix}pre")
    broken = F.sum((F.col(f"{prefix}type") != type_).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = kids.withColumn("_broken", broken).filter("_broken = 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(f"{prefix}pre", f"{prefix}text"))), lambda x: x[f"{prefix}text"])
    return run.groupBy(*key).agg(texts.alias("_inside"))


def decorators(ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """Decorator texts per symbol: inside its anchor, else the run of siblings just before.

    Python's sit in the decorated wrapper; Java's in the modifiers child.
    """
    anchors = symbols.select(*FILE, "language", F.col("node_id").alias("symbol_node"), F.col("anchor_id").alias("node_id")).distinct()
    kids = children(ast, anchors, "c_")
    python = kids.filter("language = 'python' AND c_type = 'decorator' AND node_id <> symbol_node").groupBy(*FILE, "symbol_node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c_pre", "c_text"))), lambda x: x["c_text"]).alias("decorators"))
    scripts = kids.filter(F.col("language").isin("javascript", "typescript"))
    inside = _leading_run(scripts, "decorator", [*FILE, "symbol_node"], "c_")
    before = _run_before(ast, anchors.filter(F.col("language").isin("javascript", "typescript")))
    script_symbols = anchors.filter(F.col("language").isin("javascript", "typescript")).select(*FILE, "symbol_node")
    script = script_symbols.join(inside, [*FILE, "symbol_node"], "left").join(before, [*FILE, "symbol_node"], "left").select(
        *FILE, "symbol_node", F.coalesce("_inside", "_before").alias("decorators")).filter("decorators IS NOT NULL")
    modifiers = kids.filter("language = 'java' AND c_type = 'modifiers'").groupBy(*FILE, "symbol_node").agg(
        F.min_by("c_id", "c_pre").alias("node_id"))
    java = children(ast, modifiers, "m_").filter("m_type IN ('marker_annotation', 'annotation')").groupBy(*FILE, "symbol_node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("m_pre", "m_text"))), lambda x: x["m_text"]).alias("decorators"))
    return python.unionByName(script).unionByName(java).select(*FILE, F.col("symbol_node").alias("node_id"), "decorators")


def _siblings(ast: DataFrame, anchors: DataFrame) -> DataFrame:
    """All children of the anchors' parents; `symbol_node` marks the anchors themselves."""
    parents = ast.join(anchors.select(*NODE).distinct(), NODE, "left_semi").select(*FILE, "parent_id").distinct()
    marks = anchors.select(*NODE, "symbol_node")
    return ast.filter("parent_id IS NOT NULL").join(parents, [*FILE, "parent_id"], "left_semi").join(marks, NODE, "left")


def _run_before(ast: DataFrame, anchors: DataFrame) -> DataFrame:
    """The unbroken run of decorator siblings that ends right before each anchor."""
    order = Window.partitionBy(*FILE, "parent_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = _siblings(ast, anchors).withColumn("_others", F.sum((F.col("type") != "decorator").cast("int")).over(order))
    # A decorator after k other siblings belongs to the sibling that is number k + 1.
    runs = numbered.filter("type = 'decorator'").groupBy(*FILE, "parent_id", (F.col("_others") + 1).alias("_others")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]).alias("_before"))
    marked = numbered.filter("symbol_node IS NOT NULL AND type <> 'decorator'")
    return marked.join(runs, [*FILE, "parent_id", "_others"]).select(*FILE, "symbol_node", "_before")


def clean_comment(raw: Column) -> Column:
    """Comment text without its markers; blank lines dropped; null when nothing is left."""
    text = tx.strip(raw)
    block = F.regexp_replace(F.regexp_replace(text, r"^/\*", ""), r"\*/$", "")
    lines = F.transform(tx.text_lines(block), lambda line: tx.strip(F.regexp_replace(tx.strip(line), r"^\*+", "")))
    kept = tx.strip(F.array_join(F.filter(lines, lambda line: line != ""), "\n"))
    single = tx.strip(F.regexp_replace(text, "^/+", ""))
    return F.when(text.startswith("/*"), tx.non_empty(kept)).when(text.startswith("//"), tx.non_empty(single))


def doc_comments(ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """The comment of each symbol: Python's first string statement, else the comment sibling just before."""
    before_order = Window.partitionBy(*FILE, "parent_id").orderBy("pre")
    anchors = symbols.filter("language <> 'python'").select(*FILE, F.col("node_id").alias("symbol_node"), F.col("anchor_id").alias("node_id"))
    sided = _siblings(ast, anchors).withColumn("_type", F.lag("type").over(before_order)).withColumn("_text", F.lag("text").over(before_order))
    leading = sided.filter(F.col("symbol_node").isNotNull() & F.col("_type").isin(COMMENT_TYPES)).select(
        *FILE, F.col("symbol_node").alias("node_id"), clean_comment(F.col("_text")).alias("doc_comment"))
    bodies = ast.filter("field = 'body'").select(*FILE, F.col("parent_id").alias("_symbol"), "node_id").join(
        symbols.filter("language = 'python'").select(*FILE, F.col("node_id").alias("_symbol")), [*FILE, "_symbol"], "left_semi")
    strings = _docstrings(ast, bodies).select(*FILE, F.col("_symbol").alias("node_id"), "doc_comment")
    return leading.unionByName(strings).filter("doc_comment IS NOT NULL")


def _docstrings(ast: DataFrame, blocks: DataFrame) -> DataFrame:
    """The string that is all of a block's first statement; `blocks` has node_id and `_symbol`."""
    def first(nodes: DataFrame, prefix: str) -> DataFrame:
        kids = children(ast, nodes, prefix)
        return kids.groupBy(*NODE, "_symbol").agg(
            F.min(F.struct(f"{prefix}pre", f"{prefix}type", f"{prefix}id")).alias("_f")).select(
            *FILE, F.col(f"_f.{prefix}id").alias("node_id"), "_symbol", F.col(f"_f.{prefix}type").alias("_type"))

    statements = first(blocks, "a_").filter("_type = 'expression_statement'").drop("_type")
    strings = first(statements, "b_").filter("_type = 'string'").drop("_type")
    parts = children(ast, strings, "c_").filter("c_type = 'string_content'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_pre", "c_text"))), lambda x: x["c_text"]), "")
    return parts.groupBy(*FILE, "_symbol").agg(tx.non_empty(tx.strip(text)).alias("doc_comment"))


def module_comments(ast: DataFrame) -> DataFrame:
    """The comment that opens each file."""
    roots = ast.filter("parent_id IS NULL").select(*NODE, "language", F.col("node_id").alias("_symbol"))
    strings = _docstrings(ast, roots.filter("language = 'python'").drop("language")).select(*FILE, "doc_comment")
    opening = children(ast, roots.filter("language <> 'python'"), "c_").groupBy(*FILE).agg(
        F.min(F.struct("c_pre", "c_type", "c_text")).alias("_f")).filter(F.col("_f.c_type").isin(COMMENT_TYPES)).select(
        *FILE, clean_comment(F.col("_f.c_text")).alias("doc_comment"))
    return strings.unionByName(opening).filter("doc_comment IS NOT NULL")


def heritage(ast: DataFrame, symbols: DataFrame) -> DataFrame:
    """Base classes and interfaces of each class or interface, as comma lists."""
    owners = symbols.filter(F.col("kind").isin("CLASS", "INTERFACE")).select(*NODE, "language")
    python = field_text(ast, "superclasses", "_s").join(owners.filter("language = 'python'"), NODE, "left_semi").select(
        *NODE, F.lit("superclasses").alias("role"), tx.strip(F.regexp_replace("_s", r"^[()]+|[()]+$", "")).alias("_name"), F.lit(0).alias("_at"))
    kids = children(ast, owners, "h_")

    def below(rows: DataFrame, id_: str, prefix: str) -> DataFrame:
        return children(ast, rows.select(*FILE, F.col(id_).alias("node_id"), F.col("node_id").alias("_owner"), "language"), prefix)

    clauses = below(kids.filter("h_type = 'class_heritage'"), "h_id", "k_")
    clause_rows = clauses.select(*FILE, F.col("_owner").alias("node_id"), "language", "k_id", "k_type", "k_pre", "k_text")
    extends = field_text(ast, "value", "_base").select(*FILE, F.col("node_id").alias("k_id"), "_base", F.col("_base_id"))
    script_super = clause_rows.filter("k_type = 'extends_clause'").join(extends, [*FILE, "k_id"]).select(
        *NODE, F.lit("superclasses").alias("role"), F.col("_base").alias("_name"), F.lit(0).alias("_at"))
    after = Window.partitionBy(*NODE).orderBy("k_pre")
    plain = clause_rows.withColumn("_prior", F.lag("k_type").over(after)).withColumn(
        "_clauses", F.max(F.col("k_type").isin("extends_clause", "implements_clause").cast("int")).over(Window.partitionBy(*NODE)))
    plain = plain.filter("_prior = 'extends' AND _clauses = 0").select(
        *NODE, F.lit("superclasses").alias("role"), F.col("k_text").alias("_name"), F.col("k_pre").alias("_at"))
    implements = below(clause_rows.filter("k_type = 'implements_clause'"), "k_id", "i_")
    script_impl = implements.filter("i_type IN ('type_identifier', 'identifier', 'generic_type')").select(
        *FILE, F.col("_owner").alias("node_id"), F.lit("interfaces").alias("role"), F.col("i_text").alias("_name"), F.col("i_pre").alias("_at"))
    java_super = below(kids.filter("language = 'java' AND h_field = 'superclass'"), "h_id", "s_").filter("s_type <> 'extends'").groupBy(
        *FILE, F.col("_owner").alias("node_id")).agg(F.min_by("s_text", "s_pre").alias("_name")).select(
        *NODE, F.lit("superclasses").alias("role"), "_name", F.lit(0).alias("_at"))
    lists = below(kids.filter("language = 'java' AND (h_field = 'interfaces' OR h_type = 'extends_interfaces')"), "h_id", "l_").filter(
        "l_type = 'type_list'").select(*FILE, F.col("_owner").alias("node_id"), "language", "l_id")
    java_impl = below(lists, "l_id", "t_").filter("t_type <> ','").select(
        *FILE, F.col("_owner").alias("node_id"), F.lit("interfaces").alias("role"), F.col("t_text").alias("_name"), F.col("t_pre").alias("_at"))
    rows = python.unionByName(script_super).unionByName(plain).unionByName(script_impl).unionByName(java_super).unionByName(java_impl)

    def gathered(role: str) -> Column:
        chosen = F.collect_list(F.when(F.col("role") == role, F.struct("_at", "_name")))
        return tx.non_empty(F.array_join(F.transform(F.array_sort(chosen), lambda x: x["_name"]), ", ")).alias(role)

    return rows.groupBy(*NODE).agg(gathered("superclasses"), gathered("interfaces"))


def signatures(ast: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Source from a symbol's start to its body's start, trailing punctuation stripped.

    Offsets count bytes, so the file is cut as binary.
    """
    spans = ast.select(*NODE, "start_byte", "end_byte")
    bodies = ast.filter("field = 'body' AND parent_id IS NOT NULL").select(
        *FILE, F.col("parent_id").alias("node_id"), F.col("start_byte").alias("_body"))
    sources = files.select("repository_id", F.col("path").alias("file_path"), F.col("content").cast("binary").alias("_bytes"))
    joined = symbols.select(*NODE, "language").join(spans, NODE).join(bodies, NODE, "left").join(sources, FILE)
    length = F.coalesce("_body", "end_byte") - F.col("start_byte")
    raw = F.decode(F.substring("_bytes", F.col("start_byte") + 1, length), "UTF-8")
    cut = F.coalesce(*[F.when(F.col("language") == language, F.regexp_replace(raw, tail, "")) for language, tail in SIGNATURE_TAIL.items()], raw)
    return joined.select(*NODE, cut.alias("signature"))
