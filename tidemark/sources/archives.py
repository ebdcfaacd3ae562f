"""Source files out of repository archives, and the filters of a scan."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths, text as tx
from tidemark.session import cut_lineage

ARCHIVE_DDL = (
    "repository_id string, path string, size_bytes bigint, content string, content_hash string, lines_of_code int")
BATCH_BYTES = 32_000_000


# Stores that tasks read as a stream, by the scheme of their paths; what only Spark reads comes as one row per archive.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
COLUMNS = ["repository_id", "path", "size_bytes", "content", "content_hash", "lines_of_code"]
SKIPPED_DDL = "repository_id string, path string, size_bytes bigint, reason string"


def read_archives(spark: SparkSession, archive_glob: str, suffixes: Sequence[str], max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Members of each `.tar.gz` with one of the suffixes, one row per file.

    An archive is one repository, named by its file. Spark lists the archives
    and deals them by size; a task opens its archives one after the other and
    unpacks each as a stream, in batches of bounded size, so an archive of any
    size costs time but not memory. Only stores that tasks cannot open
    themselves (`STREAMED`) hand an archive over as one row, of 2 GB at most.
    (A plain directory scan would lose every file whose name starts with `_` or
    `.`, which Spark's file sources skip.) `skipped_members` has the rest.
    """
    wanted = tuple(suffixes)

    def rows(repository: str, member: tarfile.TarInfo, inside: str, archive: tarfile.TarFile) -> tuple | None:
        if _why_skipped(member, inside, wanted, max_bytes):
            return None
        data = archive.extractfile(member).read()
        # Bytes that are not UTF-8 become replacement marks; hash and lines are those of the bytes.
        return (repository, inside, member.size, data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest(), len(data.splitlines()))

    return _unpacked(spark, archive_glob, rows, COLUMNS, ARCHIVE_DDL, lambda row: len(row[3]))


def skipped_members(spark: SparkSession, archive_glob: str, suffixes: Sequence[str], max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Members that `read_archives` leaves out, and why: not a file, too large, other suffix."""
    wanted = tuple(suffixes)

    def rows(repository: str, member: tarfile.TarInfo, inside: str, archive: tarfile.TarFile) -> tuple | None:
        reason = _why_skipped(member, inside, wanted, max_bytes)
        return (repository, inside, member.size, reason) if reason and not member.isdir() else None

    return _unpacked(spark, archive_glob, rows, ["repository_id", "path", "size_bytes", "reason"], SKIPPED_DDL, lambda row: len(row[1]))


def _why_skipped(member: tarfile.TarInfo, inside: str, wanted: tuple[str, ...], max_bytes: int) -> str | None:
    if not member.isfile():
        return "NOT_A_FILE"
    if not inside.lower().endswith(wanted):
        return "OTHER_SUFFIX"
    return "TOO_LARGE" if member.size > max_bytes else None


def _unpacked(
    spark: SparkSession, archive_glob: str, rows: Callable[..., tuple | None], columns: Sequence[str], ddl: str, weight: Callable[[tuple], int],
) -> DataFrame:
    """`rows` of every member of every archive, in batches of about `BATCH_BYTES` by `weight`."""
    listed = spark.read.format("binaryFile").load(archive_glob)
    first = listed.select("path").first()
    streamed = first is None or first["path"].split(":", 1)[0] in STREAMED
    schemes, batch_bytes = dict(STREAMED), BATCH_BYTES

    def opened(name: str):
        from pyarrow import fs

        scheme, rest = name.split(":", 1)
        if scheme == "file":
            return open("/" + rest.lstrip("/"), "rb")
        store, inside = fs.FileSystem.from_uri(f"{schemes[scheme]}:{rest}")
        return store.open_input_stream(inside)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = [None] * len(batch) if streamed else batch["content"]
            for name, blob in zip(batch["path"], blobs):
                repository = name.rsplit("/", 1)[-1].removesuffix(".tar.gz")
                held: list[tuple] = []
                size = 0
                with opened(name) if streamed else io.BytesIO(blob) as stream, tarfile.open(fileobj=stream, mode="r|gz") as archive:
                    for member in archive:
                        row = rows(repository, member, member.name.removeprefix("./"), archive)
                        # A tar reader remembers every member it has passed; a stream never goes back to them.
                        archive.members.clear()
                        if row is None:
                            continue
                        held.append(row)
                        size += weight(row)
                        if size > batch_bytes:
                            yield pd.DataFrame(held, columns=columns)
                            held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return listed.select(*(["path"] if streamed else ["path", "content"])).mapInPandas(unpack, ddl)


def write_archives(files: DataFrame, folder: str) -> DataFrame:
    """Files (repository_id, path, content) as `<repository_id>.tar.gz` in a folder every executor can reach; runs at once.

    A repository is one task's work and is written from memory, so it should be
    small. Written twice, it is the same file. Returns (repository_id, members).
    """
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        held = io.BytesIO()
        with gzip.GzipFile(fileobj=held, mode="wb", mtime=0) as zipped, tarfile.open(fileobj=zipped, mode="w") as archive:
            for path, content in rows.sort_values("path")[["path", "content"]].itertuples(index=False):
                data = (content or "").encode()
                member = tarfile.TarInfo(path)
                member.size = len(data)
                archive.addfile(member, io.BytesIO(data))
        store, inside = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(inside, recursive=True)
        with store.open_output_stream(f"{inside}/{key[0]}.tar.gz", compression=None) as out:
            out.write(held.getvalue())
        return pd.DataFrame({"repository_id": [key[0]], "members": [len(rows)]})

    written = files.select("repository_id", "path", "content").groupBy("repository_id").applyInPandas(
        pack, "repository_id string, members bigint")
    return cut_lineage(written)


def keep_sources(files: DataFrame) -> DataFrame:
    """Supported languages, no ignored folder anywhere in the path, not too large."""
    kept = ~paths.in_ignored_folder(F.col("path")) & (F.col("size_bytes") <= paths.MAX_FILE_BYTES)
    return with_language(files).filter(kept & F.col("language").isNotNull())


def keep_docs(files: DataFrame) -> DataFrame:
    """Documentation files under the same exclusions."""
    kept = ~paths.in_ignored_folder(F.col("path")) & (F.col("size_bytes") <= paths.MAX_FILE_BYTES)
    return files.filter(kept & F.lower(paths.extension(F.col("path"))).isin(paths.DOC_EXTENSIONS))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", paths.language_of(F.col("path")))


def with_file_stats(files: DataFrame) -> DataFrame:
    """Content hash, size in bytes and lines of code."""
    content = F.col("content")
    return (
        files.withColumn("content_hash", tx.content_hash(content)).withColumn("size_bytes", F.octet_length(content))
        .withColumn("lines_of_code", tx.count_lines(content)))


def scan_sources(spark: SparkSession, archive_glob: str) -> DataFrame:
    suffixes = [e for exts in paths.LANGUAGE_EXTENSIONS.values() for e in exts]
    return keep_sources(read_archives(spark, archive_glob, suffixes)).select(
        "repository_id", "path", "language", "content", "content_hash", F.col("size_bytes").cast("int"), "lines_of_code")


def scan_docs(spark: SparkSession, archive_glob: str) -> DataFrame:
    return keep_docs(read_archives(spark, archive_glob, paths.DOC_EXTENSIONS)).select(
        "repository_id", "path", "content", "content_hash", F.col("size_bytes").cast("int"))
