"""Literals derived from patterns: necessary for every match, so no finding is lost."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.functions import literals
from tidemark.operators import rules

PATTERNS = sorted({p for rule in rules.LINE_RULES for p in (*[p for p, _ in rule.any_of], *rule.all_of)} | {
    r"(?i)\bthe\b", r"a(b|cd)+e?f", r"x{2,}y|zz(?=q)", r"(?:ab)?c", r"[ab]c*d", r"(?!no)yes", r"(?>ab)c", r"a++b"})
PIECES = [
    "AKIA", "0123456789ABCDEF", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "API_KEY", "api-key", "password", "PassWord",
    "secret", " = ", ":", "'longvalue1'", '"x"', "Bearer ", "abcdefghijklmnopqrstuvwxyz", "SELECT * ", "insert into t", "' + ", "f'{x}' ", "`${a}` ",
    "verify=False", "rejectUnauthorized: false", "NODE_TLS_REJECT_UNAUTHORIZED=0", "ssl._CREATE_unverified_context", "console.log(", "logger.info (",
    "print(", "jwt.sign(", "algorithms: ['none'", "a, 'abc'", "dangerouslySetInnerHTML", ".innerHTML =", "document.write(", "| safe", "DEBUG = True",
    "debug: true", "app.debug = True", "==", "===", "bcrypt", "token", "the", "and", "abcd", "ef", "zzq", "xxy", "é", "K", "İ", " ", "\t",
]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=7), st.sampled_from(PATTERNS))
def test_every_match_holds_a_literal(pieces, pattern):
    line = "".join(pieces)
    wanted = literals.literals(pattern)
    if wanted is not None and re.search(pattern, line, re.ASCII):
        assert any(w in line.lower() for w in wanted)


@pytest.mark.parametrize("pattern, wanted", [
    (r"abc\s*=\s*xy", {"abc"}), (r"(one|three)x", {"one", "three"}), (r"a?b*", None), (r"(ab)?cde", {"cde"}), (r"(x|y*)", None), (r"\p{L}abc", None),
    (r"[abc]d", {"d"}), (r"(?i)SELECT", {"select"}), (r"(ab){2,3}", {"ab"}), (r"é1", {"1"}), (r"unclosed(", None)])
def test_literals(pattern, wanted):
    told = literals.literals(pattern)
    assert (None if told is None else set(told)) == wanted


def test_scan_equals_plain_line_tests(spark):
    ascii_only = [p for p in PIECES if p.isascii()]  # engines differ in what ends a word beyond it
    lines = [a + b + c for a in ascii_only[::2] for b in ascii_only[1::5] for c in ("", " 'longvalue1'", "(password)")]
    texts = ["\r\n".join(lines[k:k + 7]) for k in range(0, len(lines), 7)]
    files = spark.createDataFrame([("r", f"p{n}", t) for n, t in enumerate([*texts, "", None])], "repository_id string, path string, content string")
    found = {(r.type, r.file_path, r.start_line) for r in rules.scan_rules(files).collect()}
    plain = set()
    for n, text in enumerate(texts):
        for rule in rules.LINE_RULES:
            if rule.file_needs and not re.search(rule.file_needs, text) or rule.file_forbids and re.search(rule.file_forbids, text):
                continue
            for k, line in enumerate(text.split("\r\n"), 1):
                if any(re.search(p, line, re.ASCII) for p, _ in rule.any_of) and all(re.search(p, line, re.ASCII) for p in rule.all_of):
                    plain.add((rule.type, f"p{n}", k))
    assert found == plain and len({t for t, _, _ in plain}) >= 7
