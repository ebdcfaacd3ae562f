"""Line-rule findings: every rule runs in one pass over each file's lines.

Rules compile to column expressions, so a scan is an explode and a filter with
no join and no shuffle. From every pattern the literals are derived that it
cannot match without (`functions/literals.py`): a file that holds none of them
is never split into lines, and a pattern only runs on lines that hold its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import literals, text as tx
from tidemark.operators.endpoints import decorator_endpoints
from tidemark.schemas import require_columns

FINDING_COLUMNS = [
    "repository_id", "category", "type", "severity", "confidence", "title", "evidence", "file_path",
    "symbol_name", "start_line", "end_line", "metadata",
]


@dataclass(frozen=True)
class LineRule:
    """One rule over lines.

    `any_of` holds (pattern, label) pairs in order; the first that matches
    names the finding. `all_of` must match too. `file_needs` and `file_forbids`
    are tested on the whole text. `evidence` is a fixed text, `@line` for the
    trimmed line, or `@group` for the length of group `secret_group`.
    """

    type: str
    severity: str
    confidence: int
    title: str
    any_of: tuple[tuple[str, str], ...]
    all_of: tuple[str, ...] = ()
    file_needs: str | None = None
    file_forbids: str | None = None
    evidence: str | None = None
    secret_group: int = 0
    category: str = "SECURITY"


# The security rules, their patterns, severities and confidences.
SECRET_PATTERNS = (
    (r"AKIA[0-9A-Z]{16}", "AWS access key"),
    (r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "private key"),
    (r"(?i)\b(api[_-]?key|secret[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']",
     "hardcoded credential"),
    (r"(?i)Bearer\s+[A-Za-z0-9\-_.]{20,}", "hardcoded bearer token"),
)
SQL_KEYWORDS = r"(?i)\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\b"
SQL_CONCAT_PATTERNS = (
    r"(?i)(SELECT|INSERT INTO|UPDATE|DELETE FROM)[^\"'`]*[\"'`]\s*\+",
    r"(?i)f[\"'].*\{[^}]+\}.*(SELECT|INSERT INTO|UPDATE|DELETE FROM)",
    r"(?i)`[^`]*\$\{[^}]+\}[^`]*(SELECT|INSERT INTO|UPDATE|DELETE FROM)",
    r"(?i)(SELECT|INSERT INTO|UPDATE|DELETE FROM)[^`\"']*`[^`]*\$\{",
)
WEAK_TLS_PATTERNS = (
    r"verify\s*=\s*False",
    r"rejectUnauthorized\s*:\s*false",
    r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0",
    r"(?i)ssl\._create_unverified_context",
)
SENSITIVE_WORDS = r"(?i)\b(password|secret|token|api[_-]?key|ssn|credit[_-]?card)\b"
LOG_CALL = r"(?i)\b(console\.(log|info|debug|warn|error)|logger\.\w+|print|logging\.\w+)\s*\("
JWT_CALL = r"(?i)\bjwt\.(sign|verify)\s*\("
JWT_NONE = r"(?i)algorithm[s]?\s*[:=]\s*\[?[\"']none[\"']"
JWT_SHORT_SECRET = r"(?i)\bjwt\.(sign|verify)\s*\([^)]*[\"']([^\"']{1,7})[\"']"
XSS_PATTERNS = (
    r"dangerouslySetInnerHTML",
    r"\.innerHTML\s*=",
    r"document\.write\s*\(",
    r"\|\s*safe\b",
)
CORS_WILDCARD = r"(?i)origin\s*:\s*[\"']\*[\"']|Access-Control-Allow-Origin.*\*"
CORS_CREDENTIALS = r"(?i)credentials\s*:\s*true"
DEBUG_PATTERNS = (
    r"^\s*DEBUG\s*=\s*True\s*$",
    r"(?i)debug\s*:\s*true",
    r"(?i)app\.debug\s*=\s*True",
)
PASSWORD_WORD = r"(?i)\bpassword\b"
PLAIN_EQUALITY = r"==|==="
HASH_LIBRARY = r"(?i)\b(bcrypt|argon2|scrypt|pbkdf2|hashlib|password_hash|werkzeug\.security)\b"
AUTH_GUARD = (
    r"(?i)(UseGuards|Secured|PreAuthorize|RolesAllowed|RequireAuth|Authenticated|IsAuthenticated|LoginRequired"
    r"|requireAuth|authMiddleware)"
)
SESSION_MARKER = r"(?i)express-session|cookie-session|req\.session\b"
CSRF_MARKER = r"(?i)csrf"


def _plain(patterns: Sequence[str]) -> tuple[tuple[str, str], ...]:
    return tuple((pattern, "") for pattern in patterns)


HARDCODED_SECRET = LineRule(
    "HARDCODED_SECRET", "CRITICAL", 85, "Possible {label} hardcoded in {path}", SECRET_PATTERNS)
SQL_INJECTION = LineRule(
    "SQL_INJECTION_RISK", "HIGH", 70, "Possible SQL injection risk in {path}", _plain(SQL_CONCAT_PATTERNS),
    all_of=(SQL_KEYWORDS,))
WEAK_TLS = LineRule(
    "WEAK_AUTHENTICATION", "HIGH", 90, "TLS/certificate verification disabled in {path}", _plain(WEAK_TLS_PATTERNS))
SENSITIVE_LOG = LineRule(
    "SENSITIVE_DATA_EXPOSURE", "MEDIUM", 60, "Possible sensitive data in a log statement in {path}",
    _plain([LOG_CALL]), all_of=(SENSITIVE_WORDS,))
JWT_NO_ALGORITHM = LineRule(
    "WEAK_JWT", "CRITICAL", 90, "JWT algorithm set to 'none' in {path}", _plain([JWT_NONE]), file_needs=JWT_CALL,
    evidence="algorithm: 'none' permitted")
JWT_WEAK_SECRET = LineRule(
    "WEAK_JWT", "HIGH", 70, "Very short JWT signing secret in {path}", _plain([JWT_SHORT_SECRET]),
    file_needs=JWT_CALL, evidence="@group", secret_group=2)
XSS = LineRule("XSS_RISK", "HIGH", 65, "Possible XSS risk in {path}", _plain(XSS_PATTERNS), evidence="@line")
DEBUG_ON = LineRule(
    "UNSAFE_CONFIGURATION", "MEDIUM", 55, "Debug mode hardcoded on in {path}", _plain(DEBUG_PATTERNS),
    evidence="@line")
WEAK_PASSWORD = LineRule(
    "WEAK_PASSWORD_HANDLING", "HIGH", 45, "Password compared with plain equality in {path}",
    _plain([PASSWORD_WORD]), all_of=(PLAIN_EQUALITY,), file_forbids=HASH_LIBRARY, evidence="@line")

LINE_RULES = (
    HARDCODED_SECRET, SQL_INJECTION, WEAK_TLS, SENSITIVE_LOG, JWT_NO_ALGORITHM, JWT_WEAK_SECRET, XSS, DEBUG_ON,
    WEAK_PASSWORD,
)
EVIDENCE_CHARS = 200


def explode_lines(files: DataFrame, where: Column | None = None) -> DataFrame:
    """One row per line, numbered from 1, of the files that satisfy `where`.

    The test sits inside the generator: a file that fails it is never split,
    and the test is not evaluated twice by being pushed towards the scan.
    """
    require_columns(files, "repository_id", "path", "content")
    lines = tx.text_lines(F.col("content"))
    if where is not None:
        lines = F.when(where, lines)
    keep = [c for c in files.columns if c not in ("content", "path")]
    return files.select(*keep, F.col("path").alias("file_path"), F.posexplode(lines).alias("_pos", "line")).select(
        *keep, "file_path", (F.col("_pos") + 1).alias("line_no"), "line"
    )


def _needs(rule: LineRule) -> frozenset[str] | None:
    """Literals of which a line holds one if the rule finds something in it."""
    return literals.all_of([literals.any_of([p for p, _ in rule.any_of]), *[literals.literals(p) for p in rule.all_of]])


def _some_line_may_match(rules: Sequence[LineRule], lowered: Column) -> Column:
    """Whether the lower-case text holds a literal without which no rule finds anything."""
    told = [_needs(rule) for rule in rules]
    return literals.may_hold(lowered, frozenset().union(*told) if told and all(told) else None)


def _file_condition(rule: LineRule, text: Column) -> Column | None:
    condition = None
    if rule.file_needs:
        condition = text.rlike(rule.file_needs)
    if rule.file_forbids:
        veto = ~text.rlike(rule.file_forbids)
        condition = veto if condition is None else condition & veto
    return condition


def _titled(template: str, label: Column) -> Column:
    pieces: list[Column] = []
    for part in template.replace("{label}", "\0l\0").replace("{path}", "\0p\0").split("\0"):
        pieces.append(label if part == "l" else F.col("file_path") if part == "p" else F.lit(part))
    return F.concat(*pieces)


def _label(rule: LineRule, line: Column, lowered: Column, gate: Column | None) -> Column:
    """The label of the first pattern that names a finding, null for none; patterns only run on lines that hold what they need."""
    worth = literals.may_hold(lowered, _needs(rule))
    if gate is not None:
        worth = worth & gate
    for pattern in rule.all_of:
        worth = worth & line.rlike(pattern)
    return F.when(worth, F.coalesce(*[F.when(line.rlike(pattern), F.lit(name)) for pattern, name in rule.any_of]))


def _hit(rule: LineRule, line: Column, label: Column) -> Column:
    if rule.evidence == "@line":
        evidence = tx.clip(tx.strip(line), EVIDENCE_CHARS)
    elif rule.evidence == "@group":
        secret = F.regexp_extract(line, rule.any_of[0][0], rule.secret_group)
        evidence = F.concat(F.lit("Secret length: "), F.length(secret).cast("string"), F.lit(" characters"))
    else:
        evidence = F.lit(rule.evidence).cast("string")
    return F.when(
        label.isNotNull(),
        F.struct(
            F.lit(rule.category).alias("category"), F.lit(rule.type).alias("type"),
            F.lit(rule.severity).alias("severity"), F.lit(rule.confidence).alias("confidence"),
            _titled(rule.title, label).alias("title"), evidence.alias("evidence"),
            F.when(label != "", F.to_json(F.struct(label.alias("pattern")))).alias("metadata"),
        ),
    )


def scan_rules(files: DataFrame, rules: Sequence[LineRule] = LINE_RULES) -> DataFrame:
    """Findings of every rule on every line, in one scan of the files."""
    require_columns(files, "repository_id", "path", "content")
    conditions = {i: _file_condition(rule, F.col("content")) for i, rule in enumerate(rules)}
    gates = {i: f"_gate{i}" for i, condition in conditions.items() if condition is not None}
    lowered = files.select(
        "repository_id", "path", "content", *[conditions[i].alias(name) for i, name in gates.items()], F.lower("content").alias("_text"))
    lines = explode_lines(lowered, _some_line_may_match(rules, F.col("_text"))).select(
        "repository_id", "file_path", "line_no", "line", F.lower("line").alias("_low"), *gates.values())
    labels = {i: f"_label{i}" for i in range(len(rules))}
    told = lines.select("repository_id", "file_path", "line_no", "line", *[
        _label(rule, F.col("line"), F.col("_low"), F.col(gates[i]) if i in gates else None).alias(labels[i]) for i, rule in enumerate(rules)])
    # no filter on the labels: pushed below, it would run every pattern a second time
    hits = F.array_compact(F.array(*[_hit(rule, F.col("line"), F.col(labels[i])) for i, rule in enumerate(rules)]))
    found = told.select("repository_id", "file_path", "line_no", F.explode(hits).alias("hit"))
    return found.select(
        "repository_id", "hit.category", "hit.type", "hit.severity", "hit.confidence", "hit.title", "hit.evidence",
        "file_path", F.lit(None).cast("string").alias("symbol_name"), F.col("line_no").alias("start_line"),
        F.col("line_no").alias("end_line"), "hit.metadata",
    )


def whole_file_finding(files: DataFrame, condition: Column, **values) -> DataFrame:
    """One finding per file whose text satisfies `condition`."""
    hits = files.filter(condition).withColumn("file_path", F.col("path"))
    return finding_rows(hits, **values)


def finding_rows(
    df: DataFrame, type: str, severity, confidence, title: Column, category: str = "SECURITY",
    evidence: Column | None = None, symbol_name: Column | None = None, start_line: Column | None = None,
    end_line: Column | None = None, metadata: Column | None = None,
) -> DataFrame:
    """Rows in the finding layout; `df` has repository_id and file_path."""

    def column(value, cast: str) -> Column:
        return (F.lit(value) if not isinstance(value, Column) else value).cast(cast)

    return df.select(
        "repository_id", F.lit(category).alias("category"), column(type, "string").alias("type"),
        column(severity, "string").alias("severity"), column(confidence, "int").alias("confidence"),
        title.alias("title"), column(evidence, "string").alias("evidence"), "file_path",
        column(symbol_name, "string").alias("symbol_name"), column(start_line, "int").alias("start_line"),
        column(end_line, "int").alias("end_line"), column(metadata, "string").alias("metadata"),
    )


def unsafe_cors(files: DataFrame) -> DataFrame:
    """Any origin together with credentials, anywhere in one file."""
    text = F.col("content")
    return whole_file_finding(
        files, text.rlike(CORS_WILDCARD) & text.rlike(CORS_CREDENTIALS), type="UNSAFE_CONFIGURATION", severity="HIGH",
        confidence=65, title=F.concat(F.lit("CORS allows any origin together with credentials in "), "file_path"),
        evidence=F.lit("Wildcard origin + credentials:true both present"),
    )


def csrf_risk(files: DataFrame, session: str = SESSION_MARKER, defence: str = CSRF_MARKER) -> DataFrame:
    """Repositories with sessions and no mention of the defence anywhere.

    The aggregate combines before the shuffle: one row per repository and task.
    """
    text = F.col("content")
    flags = files.select("repository_id", "path", text.rlike(session).alias("s"), text.rlike(defence).alias("d"))
    repositories = flags.groupBy("repository_id").agg(
        F.min(F.when(F.col("s"), F.col("path"))).alias("file_path"), F.bool_or("d").alias("defended")
    )
    return finding_rows(
        repositories.filter(F.col("file_path").isNotNull() & ~F.col("defended")), type="CSRF_RISK", severity="MEDIUM",
        confidence=45, title=F.lit("Session-based authentication with no CSRF protection found"),
        evidence=F.lit("Session-based auth present; no 'csrf' reference found in the codebase"),
    )


def missing_authorization(symbols: DataFrame) -> DataFrame:
    """Decorated endpoints with no guard on the handler or its class."""
    endpoints = decorator_endpoints(symbols).filter(F.col("framework").isin("NestJS", "Spring Boot"))
    guarded = F.exists(F.col("decorators"), lambda d: d.rlike(AUTH_GUARD)) | F.exists(
        F.col("parent_decorators"), lambda d: d.rlike(AUTH_GUARD))
    route = F.concat("method", F.lit(" "), "path")
    return finding_rows(
        endpoints.filter(~F.coalesce(guarded, F.lit(False))), type="MISSING_AUTHORIZATION", severity="MEDIUM",
        confidence=55, title=F.concat(route, F.lit(" has no visible auth guard")), symbol_name=F.col("symbol_name"),
        metadata=F.to_json(F.struct("method", "path")),
    )
