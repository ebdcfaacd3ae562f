"""Endpoints declared by decorators, and their listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths, text as tx
from tidemark.schemas import require_columns

# What route decorators and annotations look like.
NEST_METHOD = r"(?i)@(Get|Post|Put|Delete|Patch|All)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?"
NEST_CONTROLLER = r"(?i)@Controller\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\)"
SPRING_METHOD = r"(?i)@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:(?:value\s*=\s*)?[\"']([^\"']*)[\"'])?\))?"
SPRING_ANY = r"(?i)@RequestMapping(?:\(\s*(?:(?:value\s*=\s*)?[\"']([^\"']*)[\"'])?\))?"
FLASK_ROUTE = r"(?i)@\w+\.route\(\s*[\"']([^\"']*)[\"']"
FLASK_METHODS = r"(?i)methods\s*=\s*\[([^\]]*)\]"
FASTAPI_METHOD = r"(?i)@\w+\.(get|post|put|delete|patch)\(\s*[\"']([^\"']*)[\"']"


def _route(method: Column, path: Column, framework: str) -> Column:
    return F.struct(method.alias("method"), path.alias("path"), F.lit(framework).alias("framework"))


def _method_route(decorator: Column) -> Column:
    """(method, path, framework) of a decorator, or null; earlier patterns win."""
    nest = F.upper(F.regexp_extract(decorator, NEST_METHOD, 1))
    flask_first = F.trim(F.element_at(F.split(F.regexp_extract(decorator, FLASK_METHODS, 1), ","), 1))
    flask_method = F.upper(F.regexp_replace(flask_first, "^[\"']+|[\"']+$", ""))
    return (
        F.when(decorator.rlike(NEST_METHOD), _route(
            F.when(nest == "ALL", F.lit("ANY")).otherwise(nest), F.regexp_extract(decorator, NEST_METHOD, 2), "NestJS"))
        .when(decorator.rlike(SPRING_METHOD), _route(
            F.upper(F.regexp_extract(decorator, SPRING_METHOD, 1)), F.regexp_extract(decorator, SPRING_METHOD, 2),
            "Spring Boot"))
        .when(decorator.rlike(SPRING_ANY), _route(F.lit("GET"), F.regexp_extract(decorator, SPRING_ANY, 1), "Spring Boot"))
        .when(decorator.rlike(FLASK_ROUTE), _route(
            F.coalesce(tx.non_empty(flask_method), F.lit("GET")), F.regexp_extract(decorator, FLASK_ROUTE, 1), "Flask"))
        .when(decorator.rlike(FASTAPI_METHOD), _route(
            F.upper(F.regexp_extract(decorator, FASTAPI_METHOD, 1)), F.regexp_extract(decorator, FASTAPI_METHOD, 2),
            "FastAPI"))
    )


def _class_prefix(decorator: Column) -> Column:
    return F.when(decorator.rlike(NEST_CONTROLLER), F.regexp_extract(decorator, NEST_CONTROLLER, 1)).when(
        decorator.rlike(SPRING_ANY), F.regexp_extract(decorator, SPRING_ANY, 1))


def _first_present(items: Column) -> Column:
    return F.try_element_at(F.array_compact(items), F.lit(1))


def decorator_endpoints(symbols: DataFrame) -> DataFrame:
    """The first route decorator of each method or function, under its class's prefix.

    Decorators are matched inside the symbol's own row; the only shuffle is the
    join of handlers to their classes.
    """
    require_columns(symbols, "id", "repository_id", "file_path", "parent_id", "kind", "name", "decorators")
    handlers = (
        symbols.filter(F.col("kind").isin("METHOD", "FUNCTION") & (F.size("decorators") > 0))
        .withColumn("_route", _first_present(F.transform("decorators", _method_route)))
        .filter(F.col("_route").isNotNull())
    )
    owners = symbols.select(
        "repository_id", "file_path", F.col("id").alias("parent_id"), F.col("decorators").alias("parent_decorators"),
        F.when(F.col("kind") == "CLASS", _first_present(F.transform("decorators", _class_prefix))).alias("_prefix"),
    ).filter(F.size("parent_decorators") > 0)
    joined = handlers.join(owners, ["repository_id", "file_path", "parent_id"], "left")
    return joined.select(
        "repository_id", F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "file_path",
        F.col("_route.method").alias("method"),
        paths.join_route(F.coalesce("_prefix", F.lit("")), F.col("_route.path")).alias("path"),
        F.col("_route.framework").alias("framework"), "decorators", "parent_decorators",
    )


def list_endpoints(endpoints: DataFrame, repository_id: str | None = None, method: str | None = None) -> DataFrame:
    """Endpoints of one or all repositories, in path order."""
    rows = endpoints
    if repository_id is not None:
        rows = rows.filter(F.col("repository_id") == repository_id)
    if method is not None:
        rows = rows.filter(F.col("method") == method)
    return rows.select("repository_id", "method", "path", "framework", "file_path").orderBy(
        "repository_id", "path", "method", "file_path")
