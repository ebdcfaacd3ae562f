"""Path expressions: languages, layers, labels, joins, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions per language, in parser order.
LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".mts", ".cts", ".tsx"],
    "java": [".java"],
}

# Folders that are never scanned.
IGNORED_FOLDERS = [
    ".git", "node_modules", "dist", "build", "venv", ".venv", "__pycache__",
    "target", ".next", ".turbo", "vendor", "coverage", ".pytest_cache",
]

# Documentation extensions and the largest file read.
DOC_EXTENSIONS = [".md", ".mdx"]
MAX_FILE_BYTES = 1_000_000

# Layer number of a folder name or file-name suffix.
LAYER_RANK = {
    "routes": 1, "route": 1, "controllers": 1, "controller": 1, "handlers": 1,
    "handler": 1, "api": 1,
    "services": 2, "service": 2, "usecases": 2, "usecase": 2, "domain": 2,
    "repositories": 3, "repository": 3, "repo": 3, "dao": 3, "models": 3,
    "model": 3, "entities": 3, "entity": 3,
    "infra": 4, "infrastructure": 4, "db": 4, "database": 4, "storage": 4,
}

# What each layer is called.
LAYER_NAMES = {
    1: "presentation (routes/controllers)",
    2: "application (services)",
    3: "domain (repositories/models)",
    4: "infrastructure",
}


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"\.[^.]+$", 0)


def language_of(path: Column) -> Column:
    """Language by extension, null where nothing parses the file."""
    suffix = extension(path)
    branches = [F.when(suffix.isin(exts), F.lit(name)) for name, exts in LANGUAGE_EXTENSIONS.items()]
    return F.coalesce(*branches)


def in_ignored_folder(path: Column) -> Column:
    ignored = F.array(*[F.lit(name) for name in IGNORED_FOLDERS])
    return F.arrays_overlap(F.split(path, "/"), ignored)


def join_route(prefix: Column, path: Column) -> Column:
    """One slash between prefix and path, a leading slash, none at the end."""
    left = F.regexp_replace(prefix, "/+$", "")
    right = F.regexp_replace(path, "^/+", "")
    joined = F.when(F.coalesce(prefix, F.lit("")) == "", path).otherwise(F.concat(left, F.lit("/"), right))
    return F.concat(F.lit("/"), F.regexp_replace(joined, "^/+|/+$", ""))


def short_label(path: Column) -> Column:
    """The last two segments of a longer path, after an ellipsis."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, path).otherwise(
        F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def normalise(path: Column) -> Column:
    """Fold `.` and `..` segments; `..` above the top stays, as POSIX has it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        top = F.try_element_at(done, F.lit(-1))
        pops = (part == "..") & (F.size(done) > 0) & (top != "..")
        return F.when(pops, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.array_append(done, part)
        )

    return F.array_join(F.aggregate(parts, empty, step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def layer_rank(path: Column) -> Column:
    """Layer of a path: first known folder, else the first suffix that fits."""
    segments = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    folders = F.slice(segments, F.lit(1), F.size(segments) - 1)
    known = F.filter(folders, lambda s: s.isin(list(LAYER_RANK)))
    by_folder = _rank_of(F.try_element_at(known, F.lit(1)))
    name = F.element_at(segments, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    by_suffix = None
    for suffix, rank in LAYER_RANK.items():
        fits = (stem == suffix) | stem.endswith("_" + suffix) | stem.endswith("." + suffix)
        by_suffix = F.when(fits, F.lit(rank)) if by_suffix is None else by_suffix.when(fits, F.lit(rank))
    return F.coalesce(by_folder, by_suffix)


def _rank_of(segment: Column) -> Column:
    by_rank: dict[int, list[str]] = {}
    for name, rank in LAYER_RANK.items():
        by_rank.setdefault(rank, []).append(name)
    return F.coalesce(*[F.when(segment.isin(names), F.lit(rank)) for rank, names in by_rank.items()])


def layer_name(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == key, F.lit(name)) for key, name in LAYER_NAMES.items()])
