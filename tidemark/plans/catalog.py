"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

from tidemark.plans import (  # noqa: F401
    analysis_queries,
    delivery_queries,
    finding_queries,
    graph_queries,
    incident_queries,
    index_queries,
    retrieval_queries,
    rollup_queries,
    rule_queries,
    source_queries,
    stream_queries,
    tree_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
