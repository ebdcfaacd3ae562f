"""Table schemas as DDL, and the column check at each operator's entry."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df


SOURCE_FILES = (
    "repository_id string, path string, language string, content string, "
    "content_hash string, size_bytes int, lines_of_code int"
)
SYMBOLS = (
    "id string, repository_id string, file_path string, parent_id string, kind string, name string, "
    "signature string, doc_comment string, start_line int, end_line int, decorators array<string>, "
    "superclasses string, interfaces string"
)
IMPORTS = (
    "repository_id string, file_path string, language string, position int, module string, "
    "imported_names array<string>"
)
AST_NODES = (
    "repository_id string, file_path string, language string, node_id int, parent_id int, pre int, post int, "
    "type string, is_named boolean, field string, text string, start_byte int, end_byte int, "
    "start_line int, end_line int"
)
GRAPH_EDGES = (
    "repository_id string, source_symbol_id string, source_file_path string, target_symbol_id string, "
    "target_package_name string, target_file_path string, edge_type string"
)
CHUNKS = (
    "id string, repository_id string, file_path string, symbol_id string, kind string, content string, "
    "token_count int, start_line int, end_line int, embedding array<float>"
)
API_ENDPOINTS = (
    "repository_id string, symbol_id string, file_path string, method string, path string, framework string"
)
MANIFESTS = ("repository_id string, path string, filename string, ref string, content string")
ADVISORIES = (
    "ecosystem string, name string, versions array<string>, id string, summary string, severity string, position int"
)
FINDINGS = (
    "id string, repository_id string, analysis_id string, category string, type string, severity string, "
    "priority string, title string, explanation string, evidence string, suggested_fix string, "
    "confidence int, file_path string, symbol_name string, start_line int, end_line int, "
    "related_files array<string>, metadata string, created_at timestamp"
)
ANALYSES = (
    "id string, repository_id string, status string, overall_score int, architecture_score int, "
    "security_score int, performance_score int, maintainability_score int, scalability_score int, "
    "modularity_score int, layering_score int, documentation_score int, complexity_score int, "
    "technical_debt_score int, started_at timestamp, completed_at timestamp"
)
WORKFLOW_RUN = (
    "id bigint, head_sha string, status string, conclusion string, run_started_at timestamp, "
    "created_at timestamp, updated_at timestamp, head_branch string"
)
METRIC_RESPONSE = (
    "status string, error string, data struct<resultType:string, "
    "result:array<struct<metric:map<string,string>, value:array<string>, values:array<array<string>>>>>"
)
ALERTS = (
    "organization_id string, integration_id string, fingerprint string, status string, "
    "labels map<string,string>, annotations map<string,string>, starts_at timestamp, ends_at timestamp, "
    "received_at timestamp"
)
