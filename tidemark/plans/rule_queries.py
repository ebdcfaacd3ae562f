"""Security rules over documents and over the code that parts stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import endpoints, rules
from tidemark.plans import bindings as b
from tidemark.plans.registry import add, any_match, quoted

SHOWN = ["repository_id", "type", "severity", "confidence", "title", "evidence", "file_path", "start_line"]

# The documents hold tokens of this shape; the built-in patterns match none of them.
TOKEN_RULE = rules.LineRule(
    "HARDCODED_SECRET", "CRITICAL", 85, "Possible {label} hardcoded in {path}",
    (*rules.SECRET_PATTERNS, (r'token = "[0-9a-f]{40}"', "commit token")))
LOG_WORDS = rules.LineRule(
    "SENSITIVE_DATA_EXPOSURE", "MEDIUM", 60, "Possible sensitive data in a log statement in {path}",
    ((r"(?i)\bthe\b", ""),), all_of=(r"(?i)\band\b",))
PIPE_RULE = rules.LineRule(
    "XSS_RISK", "HIGH", 65, "Possible XSS risk in {path}", ((r"\|", ""), (r"<[a-z]+", "")), evidence="@line")
WORD_VETO = rules.LineRule(
    "WEAK_PASSWORD_HANDLING", "HIGH", 45, "Password compared with plain equality in {path}",
    ((r"(?i)\bof\b", ""),), all_of=(r"(?i)\bto\b",), file_forbids=r"(?i)\b(die|les)\b", evidence="@line")


def _scan(files, *line_rules):
    return lambda spark, sf: rules.scan_rules(files(spark, sf), line_rules).select(*SHOWN)


def line_oracle(lines: str, files: str, rule: rules.LineRule, evidence: str = "NULL::VARCHAR") -> str:
    label = "CASE " + " ".join(
        f"WHEN regexp_matches(line, {quoted(p)}) THEN {quoted(name)}" for p, name in rule.any_of) + " END"
    where = [any_match("line", [p for p, _ in rule.any_of])]
    where += [f"regexp_matches(line, {quoted(p)})" for p in rule.all_of]
    if rule.file_needs:
        where.append(f"(l.repository_id, file_path) IN (SELECT (repository_id, path) FROM {files} "
                     f"WHERE regexp_matches(content, {quoted(rule.file_needs)}))")
    if rule.file_forbids:
        where.append(f"(l.repository_id, file_path) NOT IN (SELECT (repository_id, path) FROM {files} "
                     f"WHERE regexp_matches(content, {quoted(rule.file_forbids)}))")
    title = quoted(rule.title).replace("{label}", f"' || {label} || '").replace("{path}", "' || file_path || '")
    return (
        f"SELECT l.repository_id, {quoted(rule.type)} AS type, {quoted(rule.severity)} AS severity, "
        f"{rule.confidence} AS confidence, {title} AS title, {evidence} AS evidence, file_path, "
        f"line_no::INTEGER AS start_line FROM {lines} l WHERE " + " AND ".join(where)
    )


TRIMMED = "left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 200)"

add("src5_explode_lines", lambda spark, sf: rules.explode_lines(b.document_files(spark, sf)).select(
    "repository_id", "file_path", "line_no", F.md5("line").alias("line_md5")),
    "SELECT repository_id, file_path, line_no::INTEGER AS line_no, md5(line) AS line_md5 FROM doc_lines")
add("se1_hardcoded_secret", _scan(b.document_files, TOKEN_RULE), line_oracle("doc_lines", "doc_files", TOKEN_RULE))
add("se1_hardcoded_secret_code", _scan(b.code_files, rules.HARDCODED_SECRET),
    line_oracle("code_lines", "code_files", rules.HARDCODED_SECRET))
add("se2_sql_concatenation", _scan(b.code_files, rules.SQL_INJECTION),
    line_oracle("code_lines", "code_files", rules.SQL_INJECTION))
add("se3_tls_checks_off", _scan(b.code_files, rules.WEAK_TLS),
    line_oracle("code_lines", "code_files", rules.WEAK_TLS))
add("se4_sensitive_log", _scan(b.code_files, rules.SENSITIVE_LOG),
    line_oracle("code_lines", "code_files", rules.SENSITIVE_LOG))
add("se4_two_words_on_a_line", _scan(b.document_files, LOG_WORDS), line_oracle("doc_lines", "doc_files", LOG_WORDS))
add("se6_weak_jwt", _scan(b.code_files, rules.JWT_NO_ALGORITHM, rules.JWT_WEAK_SECRET),
    line_oracle("code_lines", "code_files", rules.JWT_NO_ALGORITHM, quoted("algorithm: 'none' permitted"))
    + " UNION ALL " + line_oracle(
        "code_lines", "code_files", rules.JWT_WEAK_SECRET,
        f"'Secret length: ' || length(regexp_extract(line, {quoted(rules.JWT_SHORT_SECRET)}, 2)) || ' characters'"))
add("se7_xss", _scan(b.code_files, rules.XSS), line_oracle("code_lines", "code_files", rules.XSS, TRIMMED))
add("se7_xss_documents", _scan(b.document_files, PIPE_RULE),
    line_oracle("doc_lines", "doc_files", PIPE_RULE, TRIMMED))
add("se8_cors_with_credentials", lambda spark, sf: rules.unsafe_cors(b.code_files(spark, sf)).select(*SHOWN), f"""
SELECT repository_id, 'UNSAFE_CONFIGURATION' AS type, 'HIGH' AS severity, 65 AS confidence,
       'CORS allows any origin together with credentials in ' || path AS title,
       'Wildcard origin + credentials:true both present' AS evidence, path AS file_path, NULL::INTEGER AS start_line
FROM code_files WHERE regexp_matches(content, {quoted(rules.CORS_WILDCARD)})
  AND regexp_matches(content, {quoted(rules.CORS_CREDENTIALS)})""")
add("se9_debug_on", _scan(b.code_files, rules.DEBUG_ON),
    line_oracle("code_lines", "code_files", rules.DEBUG_ON, TRIMMED))
add("se10_password_equality", _scan(b.code_files, rules.WEAK_PASSWORD),
    line_oracle("code_lines", "code_files", rules.WEAK_PASSWORD, TRIMMED))
add("se10_word_pair_with_veto", _scan(b.document_files, WORD_VETO),
    line_oracle("doc_lines", "doc_files", WORD_VETO, TRIMMED))


def _csrf_oracle(files: str, session: str, defence: str) -> str:
    return f"""
SELECT repository_id, 'CSRF_RISK' AS type, 'MEDIUM' AS severity, 45 AS confidence,
       'Session-based authentication with no CSRF protection found' AS title,
       'Session-based auth present; no ''csrf'' reference found in the codebase' AS evidence,
       min(path) FILTER (regexp_matches(content, {quoted(session)})) AS file_path, NULL::INTEGER AS start_line
FROM {files} GROUP BY repository_id
HAVING bool_or(regexp_matches(content, {quoted(session)})) AND NOT bool_or(regexp_matches(content, {quoted(defence)}))"""


add("se11_csrf", lambda spark, sf: rules.csrf_risk(b.code_files(spark, sf)).select(*SHOWN),
    _csrf_oracle("code_files", rules.SESSION_MARKER, rules.CSRF_MARKER))
add("se11_repository_wide_veto", lambda spark, sf: rules.csrf_risk(
    b.document_files(spark, sf), r"(?i)licen[cs]e", r"(?i)copyright").select(*SHOWN),
    _csrf_oracle("doc_files", r"(?i)licen[cs]e", r"(?i)copyright"))
add("fp1_all_line_rules", lambda spark, sf: rules.scan_rules(b.code_files(spark, sf)).groupBy("repository_id", "type").agg(
    F.count("*").alias("n")),
    "SELECT repository_id, type, count(*) AS n FROM (" + " UNION ALL ".join(
        line_oracle("code_lines", "code_files", rule) for rule in rules.LINE_RULES) + ") GROUP BY ALL")

# --- endpoints ----------------------------------------------------------------------

_nest, _spring, _any = quoted(endpoints.NEST_METHOD), quoted(endpoints.SPRING_METHOD), quoted(endpoints.SPRING_ANY)
_flask, _flaskm, _fast = quoted(endpoints.FLASK_ROUTE), quoted(endpoints.FLASK_METHODS), quoted(endpoints.FASTAPI_METHOD)
_control = quoted(endpoints.NEST_CONTROLLER)
b.CTES["deco"] = """
SELECT id, repository_id, file_path, parent_id, kind, name, unnest(decorators) AS d,
       unnest(range(1, len(decorators) + 1)) AS pos FROM class_symbols"""
b.CTES["deco_routes"] = f"""
SELECT *, CASE WHEN regexp_matches(d, {_nest}) THEN replace(upper(regexp_extract(d, {_nest}, 1)), 'ALL', 'ANY')
    WHEN regexp_matches(d, {_spring}) THEN upper(regexp_extract(d, {_spring}, 1))
    WHEN regexp_matches(d, {_any}) THEN 'GET'
    WHEN regexp_matches(d, {_flask}) THEN coalesce(nullif(upper(trim(trim(string_split(
        regexp_extract(d, {_flaskm}, 1), ',')[1]), '"''')), ''), 'GET')
    WHEN regexp_matches(d, {_fast}) THEN upper(regexp_extract(d, {_fast}, 1)) END AS method,
  CASE WHEN regexp_matches(d, {_nest}) THEN regexp_extract(d, {_nest}, 2)
    WHEN regexp_matches(d, {_spring}) THEN regexp_extract(d, {_spring}, 2)
    WHEN regexp_matches(d, {_any}) THEN regexp_extract(d, {_any}, 1)
    WHEN regexp_matches(d, {_flask}) THEN regexp_extract(d, {_flask}, 1)
    WHEN regexp_matches(d, {_fast}) THEN regexp_extract(d, {_fast}, 2) END AS route,
  CASE WHEN regexp_matches(d, {_nest}) THEN 'NestJS' WHEN regexp_matches(d, {_spring}) THEN 'Spring Boot'
    WHEN regexp_matches(d, {_any}) THEN 'Spring Boot' WHEN regexp_matches(d, {_flask}) THEN 'Flask'
    WHEN regexp_matches(d, {_fast}) THEN 'FastAPI' END AS framework
FROM deco WHERE kind IN ('METHOD', 'FUNCTION')"""
b.CTES["class_prefixes"] = f"""
SELECT id, arg_min(prefix, pos) AS prefix FROM (
  SELECT id, pos, CASE WHEN regexp_matches(d, {_control}) THEN regexp_extract(d, {_control}, 1)
    WHEN regexp_matches(d, {_any}) THEN regexp_extract(d, {_any}, 1) END AS prefix FROM deco WHERE kind = 'CLASS')
WHERE prefix IS NOT NULL GROUP BY id"""
b.CTES["endpoints"] = """
SELECT r.repository_id, r.id AS symbol_id, r.name AS symbol_name, r.file_path, r.method,
       '/' || trim(CASE WHEN coalesce(p.prefix, '') = '' THEN r.route
                   ELSE rtrim(p.prefix, '/') || '/' || ltrim(r.route, '/') END, '/') AS path, r.framework, r.parent_id
FROM (SELECT * FROM deco_routes WHERE method IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1) r
LEFT JOIN class_prefixes p ON p.id = r.parent_id"""

ENDPOINT = ["repository_id", "symbol_id", "file_path", "method", "path", "framework"]
add("ix8_decorator_endpoints", lambda spark, sf: endpoints.decorator_endpoints(b.class_symbols(spark, sf)).select(*ENDPOINT),
    "SELECT repository_id, symbol_id, file_path, method, path, framework FROM endpoints")
add("gr15_list_endpoints", lambda spark, sf: endpoints.list_endpoints(
    endpoints.decorator_endpoints(b.class_symbols(spark, sf)), method="GET"),
    "SELECT repository_id, method, path, framework, file_path FROM endpoints WHERE method = 'GET'")
add("se5_missing_authorization", lambda spark, sf: rules.missing_authorization(b.class_symbols(spark, sf)).select(
    "repository_id", "severity", "confidence", "title", "file_path", "symbol_name"), f"""
SELECT repository_id, 'MEDIUM' AS severity, 55 AS confidence, method || ' ' || path || ' has no visible auth guard' AS title,
       file_path, symbol_name
FROM endpoints e WHERE framework IN ('NestJS', 'Spring Boot')
  AND NOT EXISTS (SELECT 1 FROM deco d WHERE d.id IN (e.symbol_id, e.parent_id)
                  AND regexp_matches(d.d, {quoted(rules.AUTH_GUARD)}))""")
