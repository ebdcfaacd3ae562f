"""Where queries and their oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.bindings import with_ctes
from tidemark.session import ensure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}  # oracles without their common table expressions


def add(name: str, query: Query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf: query(ensure(spark, split_hot=True), sf)
    if oracle is not None:
        BODIES[name] = oracle
        ORACLES[name] = with_ctes(oracle)


def quoted(text: str) -> str:
    """`text` as an SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def any_match(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(p)})" for p in patterns) + ")"
