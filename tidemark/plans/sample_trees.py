"""Constructs of three languages, of which the files that documents stand for are made.

A construct is written as nested nodes; `layout` numbers it (pre, post from one
counter), lays its leaves out as source text and gives byte offsets and lines.
The character `#` in a leaf is replaced by one digit per use, so offsets hold.
"""

from __future__ import annotations

from functools import lru_cache

NEWLINE = "\n"


def n(type_, *kids, f=None, named=True):
    """An inner node, or a leaf when its only child is a string."""
    return {"type": type_, "field": f, "named": named, "kids": list(kids)}


def tok(text, f=None):
    return n(text, text, f=f, named=False)


def ident(text, f=None, type_="identifier"):
    return n(type_, text, f=f)


def call_py(callee, *args, f=None):
    return n("call", callee, n("argument_list", tok("("), *args, tok(")"), f="arguments"), f=f)


def call_js(callee, *args, f=None):
    return n("call_expression", callee, n("arguments", tok("("), *args, tok(")"), f="arguments"), f=f)


def attr(obj, name):
    return n("attribute", ident(obj, "object"), tok("."), ident(name, "attribute"), f="function")


def member(obj, name):
    return n("member_expression", ident(obj, "object"), tok("."),
             n("property_identifier", name, f="property"), f="function")


def string_py(text):
    return n("string", tok('"'), n("string_content", text), tok('"'))


def string_js(text, f=None):
    return n("string", tok('"'), n("string_fragment", text), tok('"'), f=f)


def params(*names, type_="parameters"):
    return n(type_, tok("("), *[ident(x) for x in names], tok(")"), f="parameters")


def function_py(name, args, *body, is_async=False, f=None):
    lead = [tok("async")] if is_async else []
    return n("function_definition", *lead, tok("def"), ident(name, "name"), params(*args), tok(":"), NEWLINE,
             n("block", *body, f="body"), f=f)


def statement(*kids):
    return n("expression_statement", *kids)


PYTHON = n(
    "module",
    statement(string_py("module notes")), NEWLINE,
    n("import_statement", tok("import"), n("dotted_name", ident("os"), f="name")), NEWLINE,
    n("import_statement", tok("import"),
      n("aliased_import", n("dotted_name", ident("numpy"), f="name"), tok("as"), ident("np", "alias"), f="name")),
    NEWLINE,
    n("import_from_statement", tok("from"), n("dotted_name", "app.db#", f="module_name"),
      tok("import"), n("dotted_name", ident("session"), f="name"), tok(","),
      n("aliased_import", n("dotted_name", ident("models"), f="name"), tok("as"), ident("m"), f="name")), NEWLINE,
    n("import_from_statement", tok("from"), n("relative_import", tok(".")), tok("import"),
      n("wildcard_import", "*")), NEWLINE,
    n("decorated_definition",
      n("decorator", tok("@"), call_py(attr("app", "route"), string_py("/x#"))), NEWLINE,
      n("decorator", tok("@"), ident("login")), NEWLINE,
      function_py(
          "get_user#", ["key"],
          statement(string_py("Fetch one user.")), NEWLINE,
          n("if_statement", tok("if"), ident("key"), tok(":"), NEWLINE,
            n("block", n("return_statement", tok("return"), call_py(attr("db", "fetchone"))), f="consequence"),
            NEWLINE,
            n("elif_clause", tok("elif"), n("boolean_operator", ident("a"), tok("and", "operator"), ident("b")),
              tok(":"), n("block", n("pass_statement", tok("pass")))), NEWLINE,
            n("elif_clause", tok("elif"), ident("c"), tok(":"), n("block", n("pass_statement", tok("pass")))),
            NEWLINE,
            n("elif_clause", tok("elif"), ident("d"), tok(":"), n("block", n("pass_statement", tok("pass")))),
            NEWLINE,
            n("elif_clause", tok("elif"), ident("e"), tok(":"), n("block", n("pass_statement", tok("pass"))))),
          f="definition")), NEWLINE,
    n("class_definition", tok("class"), ident("Store#", "name"),
      n("argument_list", tok("("), ident("Base"), tok(","), ident("Mixin"), tok(")"), f="superclasses"), tok(":"),
      NEWLINE,
      n("block",
        statement(string_py("Keeps things.")), NEWLINE,
        function_py("__init__", ["self"],
                    statement(n("assignment", ident("conn", "left"), tok("="),
                                call_py(ident("Client", "function"), f="right"))), NEWLINE,
                    statement(n("assignment", ident("unused#", "left"), tok("="),
                                call_py(ident("helper", "function"), f="right"))), NEWLINE,
                    statement(call_py(attr("conn", "open")))), NEWLINE,
        n("decorated_definition", n("decorator", tok("@"), ident("property")), NEWLINE,
          function_py("size", ["self"], n("raise_statement", tok("raise"), ident("NotImplementedError")),
                      f="definition")),
        f="body")), NEWLINE,
    function_py(
        "load_all", ["rows", "cache"],
        n("for_statement", tok("for"), ident("row", "left"), tok("in"), ident("rows", "right"), tok(":"), NEWLINE,
          n("block",
            statement(call_py(attr("db", "execute"), ident("row"))), NEWLINE,
            statement(n("assignment", ident("fixed", "left"), tok("="),
                        n("list", tok("["), n("integer", "1"), tok(","), n("integer", "2"), tok("]"), f="right"))),
            NEWLINE,
            statement(n("assignment", ident("used", "left"), tok("="),
                        n("list", tok("["), ident("row"), tok("]"), f="right"))), NEWLINE,
            statement(n("comparison_operator", ident("row"), tok("in", "operators"), ident("cache"))), NEWLINE,
            n("while_statement", tok("while"), ident("used"), tok(":"), NEWLINE,
              n("block",
                n("for_statement", tok("for"), ident("x", "left"), tok("in"), ident("used", "right"), tok(":"),
                  n("block", statement(call_py(attr("db", "query"), ident("x"))), f="body")), f="body")),
            f="body"))), NEWLINE,
    function_py("tick", [], statement(call_py(attr("time", "sleep"), n("integer", "5"))), NEWLINE,
                statement(call_py(attr("db", "fetchall"))), is_async=True), NEWLINE,
)

JAVASCRIPT = n(
    "program",
    n("comment", "/* entry point */"), NEWLINE,
    n("import_statement", tok("import"),
      n("import_clause", ident("def#"), tok(","),
        n("named_imports", tok("{"), n("import_specifier", ident("a", "name")), tok(","),
          n("import_specifier", ident("b", "name"), tok("as"), ident("c", "alias")), tok("}"))),
      tok("from"), string_js("./lib#", "source")), NEWLINE,
    n("import_statement", tok("import"),
      n("import_clause", n("namespace_import", tok("*"), tok("as"), ident("ns"))),
      tok("from"), string_js("pkg", "source")), NEWLINE,
    n("lexical_declaration", tok("const"),
      n("variable_declarator", n("object_pattern", tok("{"), n("shorthand_property_identifier_pattern", "one"),
                                 tok(","), n("pair_pattern", n("property_identifier", "two", f="key"), tok(":"),
                                             ident("alias", "value")), tok("}"), f="name"), tok("="),
        call_js(ident("require", "function"), string_js("mod#"), f="value"))), NEWLINE,
    n("comment", "// adds numbers"), NEWLINE,
    n("export_statement", tok("export"),
      n("lexical_declaration", tok("const"),
        n("variable_declarator", ident("add", "name"), tok("="),
          n("arrow_function", params("x", "y", type_="formal_parameters"), tok("=>"),
            n("statement_block", tok("{"), n("return_statement", tok("return"),
              n("binary_expression", ident("x", "left"), tok("&&", "operator"), ident("y", "right"))), tok("}"),
              f="body"), f="value")), f="declaration")), NEWLINE,
    n("comment", "/** Order service.\n * keeps orders\n */"), NEWLINE,
    n("class_declaration",
      n("decorator", tok("@"), call_js(ident("Controller", "function"), string_js("orders#"))), NEWLINE,
      tok("class"), n("type_identifier", "Orders#", f="name"),
      n("class_heritage",
        n("extends_clause", tok("extends"), ident("Base", "value")),
        n("implements_clause", tok("implements"), n("type_identifier", "Handler"), tok(","),
          n("type_identifier", "Closer"))),
      n("class_body", tok("{"), NEWLINE,
        n("method_definition", n("property_identifier", "constructor", f="name"),
          params(type_="formal_parameters"),
          n("statement_block", tok("{"),
            statement(n("new_expression", tok("new"), ident("Pool", "constructor"), n("arguments", tok("("), tok(")"),
                                                                                    f="arguments"))), tok("}"),
            f="body")), NEWLINE,
        n("decorator", tok("@"), call_js(ident("Get", "function"), string_js("/all"))), NEWLINE,
        n("decorator", tok("@"), ident("Audit")), NEWLINE,
        n("method_definition", tok("async"), n("property_identifier", "findOrders", f="name"),
          params("q", type_="formal_parameters"),
          n("statement_block", tok("{"), NEWLINE,
            n("for_in_statement", tok("for"), tok("("), ident("o", "left"), tok("of"), ident("q", "right"), tok(")"),
              n("statement_block", tok("{"), NEWLINE,
                statement(call_js(member("db", "findMany"), ident("o"))), NEWLINE,
                statement(call_js(member("list", "includes"), ident("o"))), NEWLINE,
                statement(call_js(member("fs", "readFileSync"), string_js("f"))), NEWLINE,
                n("lexical_declaration", tok("const"),
                  n("variable_declarator", ident("lost#", "name"), tok("="),
                    n("object", tok("{"), n("pair", n("property_identifier", "k", f="key"), tok(":"),
                                            n("number", "1", f="value")), tok("}"), f="value"))), tok("}"),
                f="body")), tok("}"), f="body")), NEWLINE,
        tok("}"), f="body")), NEWLINE,
    statement(call_js(member("router", "get"), string_js("/items#"), ident("list"))), NEWLINE,
    statement(call_js(member("other", "post"), string_js("/skip"), ident("list"))), NEWLINE,
    n("function_declaration", tok("function"), ident("pick", "name"), params("k", type_="formal_parameters"),
      n("statement_block", tok("{"),
        n("switch_statement", tok("switch"), ident("k", "value"),
          n("switch_body", tok("{"),
            *[n("switch_case", tok("case"), n("number", str(i), f="value"), tok(":")) for i in range(5)],
            tok("}"), f="body")), tok("}"), f="body")), NEWLINE,
)

JAVA = n(
    "program",
    n("import_declaration", tok("import"), n("scoped_identifier", "com.acme.Item#"), tok(";")), NEWLINE,
    n("import_declaration", tok("import"), n("scoped_identifier", "java.util"), tok("."), n("asterisk", "*"),
      tok(";")), NEWLINE,
    n("block_comment", "/* Holds items. */"), NEWLINE,
    n("class_declaration",
      n("modifiers", n("marker_annotation", "@RestController"), NEWLINE,
        n("annotation", '@RequestMapping("/items#")'), tok("public")),
      tok("class"), ident("ItemApi#", "name"),
      n("superclass", tok("extends"), n("type_identifier", "BaseApi"), f="superclass"),
      n("super_interfaces", tok("implements"),
        n("type_list", n("type_identifier", "Api"), tok(","), n("type_identifier", "Closeable")), f="interfaces"),
      n("class_body", tok("{"), NEWLINE,
        n("constructor_declaration", ident("ItemApi#", "name"), params(type_="formal_parameters"),
          n("constructor_body", tok("{"),
            statement(n("object_creation_expression", tok("new"), n("type_identifier", "Helper", f="type"),
                        n("argument_list", tok("("), tok(")"), f="arguments"))), tok("}"), f="body")), NEWLINE,
        n("line_comment", "// all items"), NEWLINE,
        n("method_declaration", n("modifiers", n("annotation", '@GetMapping("/all")'), tok("public")),
          n("void_type", "void", f="type"), ident("findItems", "name"), params("id", type_="formal_parameters"),
          n("block", tok("{"), NEWLINE,
            n("enhanced_for_statement", tok("for"), tok("("), ident("i", "name"), tok(":"), ident("xs", "value"),
              tok(")"), n("block", tok("{"),
                          statement(n("method_invocation", ident("repo", "object"), tok("."), ident("findById", "name"),
                                      n("argument_list", tok("("), tok(")"), f="arguments"))), tok("}"), f="body")),
            NEWLINE,
            n("if_statement", tok("if"),
              n("binary_expression", ident("a", "left"), tok("||", "operator"), ident("b", "right"), f="condition"),
              n("block", tok("{"), tok("}"), f="consequence")), tok("}"), f="body")), NEWLINE,
        tok("}"), f="body")), NEWLINE,
    n("interface_declaration", tok("interface"), ident("Api", "name"),
      n("extends_interfaces", tok("extends"), n("type_list", n("type_identifier", "Root"))),
      n("interface_body", tok("{"),
        n("method_declaration", n("void_type", "void", f="type"), ident("close", "name"),
          params(type_="formal_parameters"), tok(";")), tok("}"), f="body")), NEWLINE,
)

TREES = {"python": PYTHON, "javascript": JAVASCRIPT, "java": JAVA}


@lru_cache(maxsize=None)
def layout(language: str, number: int) -> tuple[tuple, str]:
    """(node tuples, source text) of one construct under a root; numbers, bytes and lines count from the construct's begin."""
    rows: list[dict] = []
    text: list[str] = []
    state = {"counter": 0, "at": 0, "line": 1, "id": 0}

    def emit(piece: str) -> None:
        text.append(piece)
        state["at"] += len(piece.encode())
        state["line"] += piece.count("\n")

    def walk(node: dict, parent: int | None) -> None:
        state["id"] += 1
        row = {"node_id": state["id"], "parent_id": parent, "pre": state["counter"], "type": node["type"],
               "is_named": node["named"], "field": node["field"]}
        state["counter"] += 1
        rows.append(row)
        leaf = len(node["kids"]) == 1 and isinstance(node["kids"][0], str) and node["kids"][0] != NEWLINE
        started = False
        if leaf:
            if text and not text[-1].endswith(("\n", " ")):
                emit(" ")
            row["start_byte"], row["start_line"] = state["at"], state["line"]
            emit(node["kids"][0])
        else:
            for kid in node["kids"]:
                if kid == NEWLINE:
                    emit("\n")
                    continue
                if not started and text and not text[-1].endswith(("\n", " ")):
                    emit(" ")
                if not started:
                    row["start_byte"], row["start_line"] = state["at"], state["line"]
                    started = True
                walk(kid, row["node_id"])
        row.setdefault("start_byte", state["at"])
        row.setdefault("start_line", state["line"])
        row["post"], row["end_byte"], row["end_line"] = state["counter"], state["at"], state["line"]
        state["counter"] += 1

    walk(constructs(language)[number], None)
    source = "".join(text)
    data = source.encode()
    for row in rows:
        row["text"] = data[row["start_byte"]:row["end_byte"]].decode().strip()
        row["end_byte"] = row["start_byte"] + len(row["text"].encode())
        row["end_line"] = row["start_line"] + row["text"].count("\n")
        # the root goes: it is the file's
        row.update(node_id=row["node_id"] - 1, pre=row["pre"] - 1, post=row["post"] - 1, start_line=row["start_line"] - 1,
                   end_line=row["end_line"] - 1, parent_id=(row["parent_id"] or 1) - 1)
    return tuple(tuple(sorted(r.items())) for r in rows[1:]), source


@lru_cache(maxsize=None)
def constructs(language: str) -> tuple[dict, ...]:
    """What stands at the top of a sample tree, each under a root of its own; a comment goes with what follows it."""
    tree = TREES[language]
    out, held = [], []
    for kid in tree["kids"]:
        if kid == NEWLINE:
            continue
        held += [kid, NEWLINE]
        if "comment" not in kid["type"]:
            out.append({**tree, "kids": held})
            held = []
    return tuple(out)


def units(language: str) -> list[dict]:
    """Constructs as records: sizes, source text and nodes."""
    out = []
    for number in range(len(constructs(language))):
        nodes, source = layout(language, number)
        rows = [dict(row) for row in nodes]
        out.append({"nodes": rows, "source": source, "size": len(rows), "ticks": 2 * len(rows), "bytes": len(source.encode()),
                    "lines": source.count("\n")})
    return out
