"""Import resolution: from a module name to the file it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.schemas import require_columns

# What is tried after a relative script import, in order.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
SCRIPT_INDEXES = ["index.ts", "index.tsx", "index.js", "index.jsx"]


def _script_stem(source: Column, module: Column) -> Column:
    joined = paths.normalise(F.concat(paths.folder_of(source), F.lit("/"), module))
    return F.when(module.startswith("."), F.when(joined == "", F.lit(".")).otherwise(joined))


def _python_stem(source: Column, module: Column) -> Column:
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    folder = paths.folder_of(source)
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (F.greatest(dots, F.lit(1)) - 1), F.lit(0))), "/")
    relative = F.when(rest == "", base).otherwise(paths.normalise(F.concat(base, F.lit("/"), rest)))
    return F.when(dots > 0, relative).otherwise(rest)


def _stem(family: str, order: int, stem: Column, fits: Column) -> Column:
    return F.when(fits, F.struct(F.lit(family).alias("_family"), stem.alias("_stem"), F.lit(order).alias("_order")))


def file_stems(files: DataFrame) -> DataFrame:
    """What a module may be called, per language family, and the file it then means.

    A file answers to its own path, to its path without ending, and as an index
    or package file to its folder; a Java file to each trailing part of its
    path. Where several files share a name the first in probing order wins,
    and among Java files the smallest path.
    """
    path, name, folder = F.col("path"), F.element_at(F.split("path", "/"), -1), paths.folder_of(F.col("path"))
    options = [_stem("script", 0, path, F.lit(True))]
    for order, ending in enumerate(SCRIPT_ENDINGS):
        if ending:
            options.append(_stem("script", order, F.regexp_replace(path, f"\\{ending}$", ""), path.endswith(ending)))
    for order, index in enumerate(SCRIPT_INDEXES, start=len(SCRIPT_ENDINGS)):
        options.append(_stem("script", order, folder, (name == index) & (folder != "")))
    options.append(_stem("python", 0, F.regexp_replace(path, r"\.py$", ""), path.endswith(".py")))
    options.append(_stem("python", 1, folder, name == "__init__.py"))
    parts = F.split(F.regexp_replace(path, r"\.java$", ""), "/")
    trailing = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.lit("java").alias("_family"), F.array_join(F.slice(parts, -n, n), "/").alias("_stem"), F.lit(0).alias("_order")))
    named = F.concat(F.array_compact(F.array(*options)), F.when(path.endswith(".java"), trailing).otherwise(F.array().cast(
        "array<struct<_family:string,_stem:string,_order:int>>")))
    exploded = files.select("repository_id", "path", F.inline(named))
    best = F.min(F.struct("_order", "path"))
    return exploded.groupBy("repository_id", "_family", "_stem").agg(best.alias("_best")).select(
        "repository_id", "_family", "_stem", F.col("_best.path").alias("target_path"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with `target_path`, null where no file of the repository fits.

    Each import becomes the one name it looks for, and joins the table of names
    files answer to by equality. Nothing is multiplied on the import side; a
    file that everything imports is a hot key of the left side, which adaptive
    execution splits. Imports that name no file (packages) skip the join.
    """
    require_columns(imports, "repository_id", "file_path", "language", "module")
    module, source = F.col("module"), F.col("file_path")
    family = F.when(F.col("language").isin("javascript", "typescript"), "script").when(
        F.col("language").isin("python", "java"), F.col("language"))
    stem = (
        F.when(family == "script", _script_stem(source, module)).when(family == "python", _python_stem(source, module))
        .when(family == "java", F.replace(module, F.lit("."), F.lit("/"))))
    key = ["repository_id", "_family", "_stem"]
    wanted = imports.withColumn("_family", family).withColumn("_stem", stem)
    external = wanted.filter("_stem IS NULL OR _family IS NULL").select(*imports.columns, F.lit(None).cast("string").alias("target_path"))
    inside = wanted.filter("_stem IS NOT NULL AND _family IS NOT NULL").join(file_stems(files), key, "left")
    return inside.select(*imports.columns, "target_path").unionByName(external)


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """One IMPORTS edge per import, with the target path where it resolves."""
    return resolve_imports(imports, files).select(
        "repository_id", F.col("file_path").alias("source_file_path"), F.col("module").alias("target_package_name"),
        F.col("target_path").alias("target_file_path"), F.lit("IMPORTS").alias("edge_type"))
