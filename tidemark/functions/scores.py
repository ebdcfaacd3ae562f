"""Numeric and ranking expressions shared by scores and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from least to most serious.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Points a finding takes off a score.
SEVERITY_PENALTY = {"CRITICAL": 12, "HIGH": 6, "MEDIUM": 3, "LOW": 1, "INFO": 0}


def lookup(key: Column, table: dict, default=None) -> Column:
    """`table[key]` as one CASE expression, so that it stays in codegen."""
    result = None
    for name, value in table.items():
        hit = key == F.lit(name)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return result.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {name: rank for rank, name in enumerate(SEVERITIES)}, 0)


def severity_name(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(SEVERITIES)))


def severity_penalty(severity: Column) -> Column:
    return lookup(severity, SEVERITY_PENALTY, 0)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def score_band(score: Column) -> Column:
    """Band of a score: 80 and over good, 60 and over fair, below poor."""
    return (
        F.when(score.isNull(), F.lit("none"))
        .when(score >= 80, F.lit("good"))
        .when(score >= 60, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size)).cast("long"))
