"""Centroid clustering over dictionaries of subvectors.

Vectors become whole numbers and are encoded once, without loss: a chunk of
them keeps, for every block of dimensions, the distinct subvectors that occur
and one code per vector. A round measures each distinct subvector against every
centroid once; a vector's squared distance is then the sum of the entries that
its codes name, and the sums of a cluster's members come from counts of codes.
Blocks start as single dimensions and neighbours are joined as long as the
dictionary stays well below the number of vectors it serves.

Chunks lie in a table in the shared folder that every round reads; nothing but
sums per task and centroid leaves a round, so no vector is shuffled. Numbers of
any size are exact: wide ones are held as Python integers and sums travel as
digits.

Vectors that are null, of another length, or hold a null or non-finite
component take no part. A null id is ordered as an empty text and repeated rows
count as often as they occur. With fewer vectors than centroids each is one; an
empty table gives no rows. Distances and sums beyond 64 bits are returned as
the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, scratch_path

DIMENSIONS, SCALE = 64, 256
CHUNK = 16_384  # vectors that share dictionaries; codes fit 16 bits
SPARE = 4  # a joined dictionary serves at least so many vectors per entry
LARGEST = 2 ** 63 - 1
DIGIT = 60  # bits of a digit in which sums travel

Block = tuple[int, np.ndarray, np.ndarray]  # first dimension, distinct subvectors, code of each vector


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == dimensions) & finite, F.lit(False))


def blocks_of(values: np.ndarray) -> list[Block]:
    """Dictionaries of neighbouring dimensions, as wide as they pay."""
    most = max(1, len(values) // SPARE)
    done: list[Block] = []
    open_: list[Block] = []
    for dimension in range(values.shape[1]):
        words, codes = np.unique(values[:, dimension], return_inverse=True)
        open_.append((dimension, words[:, None], codes))
    while open_:
        merged: list[Block] = []
        n = 0
        while n < len(open_):
            first, words, codes = open_[n]
            joined = None
            if n + 1 < len(open_) and open_[n + 1][0] == first + words.shape[1]:
                _, others, more = open_[n + 1]
                if max(len(words), len(others)) <= most:
                    pairs, numbers = np.unique(codes * len(others) + more, return_inverse=True)
                    if len(pairs) <= most:
                        joined = first, np.concatenate([words[pairs // len(others)], others[pairs % len(others)]], axis=1), numbers
            if joined:
                merged.append(joined)
                n += 2
            else:
                done.append(open_[n])
                n += 1
        open_ = merged
    return sorted(done, key=lambda block: block[0])


def encode(vectors: DataFrame, dimensions: int = DIMENSIONS, chunk: int = CHUNK) -> DataFrame:
    """Chunks (ids, kind, first, width, entries, words, codes) of the rows of `vectors` (vec_id, embedding)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                some = batch.slice(begin, chunk - rows)
                held.append(some)
                rows += some.num_rows
                begin += some.num_rows
                if rows == chunk:
                    yield one(held)
                    held, rows = [], 0
        if rows:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held])
        flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.float64)
        values = np.floor(flat * SCALE).reshape(-1, dimensions)
        reach = np.abs(values).max()
        kind = "<i2" if reach < 2 ** 15 else "<i4" if reach < 2 ** 31 else "<f8"
        found = blocks_of(values)
        return pa.RecordBatch.from_arrays([
            pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([kind]),
            pa.array([[b[0] for b in found]], pa.list_(pa.int32())),
            pa.array([[b[1].shape[1] for b in found]], pa.list_(pa.int32())),
            pa.array([[len(b[1]) for b in found]], pa.list_(pa.int32())),
            pa.array([b"".join(b[1].astype(kind).tobytes() for b in found)], pa.binary()),
            pa.array([b"".join(b[2].astype("<u2").tobytes() for b in found)], pa.binary()),
        ], names=["ids", "kind", "first", "width", "entries", "words", "codes"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(
        work, "ids array<long>, kind string, first array<int>, width array<int>, entries array<int>, words binary, codes binary")


def decoded(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[Block]]]:
    """(ids, blocks) of each chunk of a batch; words are int64, or Python integers where they are wide."""
    for n in range(batch.num_rows):
        ids, kind, first, width, entries, words, codes = (batch.column(c)[n] for c in range(7))
        flat = np.frombuffer(words.as_buffer(), kind.as_py())
        whole = np.array([int(x) for x in flat], object) if kind.as_py() == "<f8" else flat.astype(np.int64)
        numbers = np.frombuffer(codes.as_buffer(), "<u2").reshape(len(first), -1)
        out, at = [], 0
        for begin, wide, size, own in zip(first.as_py(), width.as_py(), entries.as_py(), numbers, strict=True):
            out.append((begin, whole[at:at + wide * size].reshape(size, wide), own))
            at += wide * size
        yield ids.values, out


def nearest(blocks: list[Block], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector of a chunk; the smaller of equally near clusters."""
    reach = max(max(abs(int(b[1].max())), abs(int(b[1].min()))) for b in blocks) + max(abs(x) for c in centroids for x in c)
    most = reach * reach * len(centroids[0])
    kind = np.int32 if most < 2 ** 31 else np.int64 if most < 2 ** 63 else object
    centres = np.array(centroids, object).astype(kind)
    total = np.zeros((len(blocks[0][2]), len(centroids)), kind)
    for begin, words, codes in blocks:
        entry = np.zeros((len(words), len(centroids)), kind)
        for offset in range(words.shape[1]):
            apart = words[:, offset, None].astype(kind) - centres[None, :, begin + offset]
            entry += apart * apart
        total += entry[codes]
    cluster = total.argmin(axis=1) if kind is not object else np.array([min(range(len(t)), key=t.__getitem__) for t in total])
    return cluster, total[np.arange(len(total)), cluster]


def sums(encoded: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """(members, sum of each component) per cluster that has members; one small row per task, cluster and component moves."""
    k, dimensions = len(centroids), len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 1), object)
        for batch in batches:
            for _, blocks in decoded(batch):
                cluster, _ = nearest(blocks, centroids)
                total[:, dimensions] += np.bincount(cluster, minlength=k).astype(object)
                for begin, words, codes in blocks:
                    counts = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
                    total[:, begin:begin + words.shape[1]] += (counts.astype(words.dtype) @ words).astype(object)
        rows = [(c, d, place, digit) for c in range(k) for d in range(dimensions + 1) for place, digit in digits(int(total[c, d]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                names=["cluster", "dimension", "place", "digit"])

    told = encoded.mapInArrow(work, "cluster int, dimension int, place int, digit long").groupBy("cluster", "dimension", "place").agg(
        F.sum(F.col("digit").cast("decimal(28,0)")).alias("digit")).collect()
    out: dict[int, list[int]] = {}
    for row in told:  # k * (dimensions + 1) rows and few digits of each
        out.setdefault(row["cluster"], [0] * (dimensions + 1))[row["dimension"]] += int(row["digit"]) << (DIGIT * row["place"])
    return {c: (v[dimensions], v[:dimensions]) for c, v in out.items() if v[dimensions]}


def digits(total: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**DIGIT, all with its sign."""
    sign, rest, place = (-1, -total, 0) if total < 0 else (1, total, 0)
    while rest:
        yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest >>= DIGIT
        place += 1


def first_centroids(vectors: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors with the least hashes of salt and id, in that order; `clusters` rows reach the driver."""
    name = F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("hash"), "embedding").orderBy("hash", "embedding").limit(clusters).collect()
    return [[int(np.floor(float(x) * SCALE)) for x in row["embedding"]] for row in rows]


def cluster(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, salt: str = "2:", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the usable rows of `vectors` (vec_id, embedding).

    Every round reads the encoded table; an executor lost costs its tasks of
    one round. The driver holds the centroids only.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"), dimensions))
    path = scratch_path(spark, "subvectors")
    encode(kept, dimensions).write.parquet(path)
    encoded = spark.read.parquet(path)
    centroids = first_centroids(kept, clusters, salt)
    for _ in range(rounds if centroids else 0):
        for number, (members, total) in sums(encoded, centroids).items():
            centroids[number] = [x // members for x in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blocks in decoded(batch):
                number, distance = nearest(blocks, centroids)
                if distance.dtype == object:
                    distance = np.array([min(d, LARGEST) for d in distance], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))],
                                                 names=["vec_id", "cluster", "distance"])

    assigned = cut_lineage(encoded.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    wide = F.sum(F.col("distance").cast("decimal(28,0)"))
    inertia = {row["cluster"]: int(row["sum"]) for row in assigned.groupBy("cluster").agg(wide.alias("sum")).collect()}
    whole = min(sum(inertia.values()), LARGEST)
    names = [(n, min(total, LARGEST), whole, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
             for n, total in sorted(inertia.items())]
    # one row per cluster
    told = F.broadcast(spark.createDataFrame(names, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(told, F.col("cluster") == F.col("_cluster")).drop("_cluster")
