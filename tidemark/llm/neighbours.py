"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is hashed into one bucket per table by projections on Gaussian
directions cut into slots. A query visits, per table, the non-empty buckets in
the order of estimated success (least squared distance from the query to the
slots of the bucket); what it finds in all tables is merged and ranked by the
exact inner product in double precision.

For the largest inner product, vectors get one more component that makes their
norms equal, so near in distance is large in product.

Vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows without an id or of another length than the most frequent
one. Repeated ids count once, with their best score. An empty table has no
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_BITS = 12


def usable(batch: pa.RecordBatch, length: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, lengths) of the rows of (id, vector) that take part."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    good = pc.is_valid(ids).to_numpy(zero_copy_only=False) & (sizes > 0)
    if length is not None:
        good &= sizes == length
    mask = pa.array(good)
    kept, sizes = lists.filter(mask), sizes[good]
    flat = pc.cast(pc.list_flatten(kept), pa.float64()).to_numpy(zero_copy_only=False)
    return ids.filter(mask).to_numpy(zero_copy_only=False).astype(np.int64), flat, sizes


def matrix(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one length, as rows of doubles."""
    ids, flat, _ = usable(batch, length)
    rows = flat.reshape(-1, length)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return ids[good], rows[good]


@dataclass
class Tables:
    """The hash functions: directions, offsets, slot width, and the norm all vectors are lifted to."""

    directions: np.ndarray  # tables x (length + 1) x functions
    offsets: np.ndarray  # tables x functions
    width: float
    norm: float

    @classmethod
    def draw(cls, length: int, norm: float, tables: int, functions: int, width: float, seed: int) -> Tables:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(tables, length + 1, functions)), rng.uniform(0, width, (tables, functions)), width, norm)

    def places(self, table: int, rows: np.ndarray) -> np.ndarray:
        """Positions along the directions, in slots; the whole part is the slot."""
        lifted = np.sqrt(np.maximum(self.norm ** 2 - np.square(rows).sum(axis=1), 0.0))
        along = rows @ self.directions[table][:-1] + lifted[:, None] * self.directions[table][-1]
        return (along / self.norm + self.offsets[table]) / self.width

    def codes(self, table: int, rows: np.ndarray) -> np.ndarray:
        return encode(np.floor(self.places(table, rows)).astype(np.int64))


def encode(slots: np.ndarray) -> np.ndarray:
    """One number per row of slots."""
    half = 1 << (SLOT_BITS - 1)
    out = np.zeros(len(slots), np.int64)
    for n in range(slots.shape[1]):
        out = (out << SLOT_BITS) | np.clip(slots[:, n] + half, 0, 2 * half - 1)
    return out


def decode(codes: np.ndarray, functions: int) -> np.ndarray:
    half = 1 << (SLOT_BITS - 1)
    return np.stack([((codes >> (SLOT_BITS * (functions - 1 - n))) & (2 * half - 1)) - half for n in range(functions)], axis=1)


def probes(places: np.ndarray, slots: np.ndarray, sizes: np.ndarray, most: int, least: int) -> list[np.ndarray]:
    """Per query the numbers of the `most` buckets likeliest to hold neighbours, and further ones until they hold `least` rows."""
    score = np.zeros((len(places), len(slots)))
    for n in range(slots.shape[1]):
        below = slots[None, :, n] - places[:, None, n]  # the slot begins so far above the query
        score += np.square(np.maximum(np.maximum(below, -1.0 - below), 0.0))
    most = min(most, len(slots))
    out = list(np.argpartition(score, most - 1, axis=1)[:, :most])
    for n, chosen in enumerate(out):
        if sizes[chosen].sum() < least:
            order = np.argsort(score[n], kind="stable")
            out[n] = order[:np.searchsorted(np.cumsum(sizes[order]), least) + 1]
    return out


@dataclass
class Directory:
    """Non-empty buckets of a table in order of code: rows, first group and number of groups of each."""

    codes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    splits: np.ndarray


def plan_groups(counted: dict[int, list[tuple[int, int]]], tables: int, group_rows: int) -> list[Directory]:
    """Groups of about `group_rows` vectors: neighbouring buckets share one, a large bucket gets several of its own."""
    out, group = [], 0
    for table in range(tables):
        codes, sizes, first, splits, filled = [], [], [], [], 0
        for code, n in sorted(counted.get(table, [])):
            cuts = -(-n // group_rows)
            if filled and (cuts > 1 or filled + n > group_rows):
                group, filled = group + 1, 0
            codes.append(code)
            sizes.append(n)
            first.append(group)
            splits.append(cuts)
            if cuts > 1:
                group, filled = group + cuts, 0
            else:
                filled += n
        group += bool(filled)
        out.append(Directory(np.array(codes, np.int64), np.array(sizes, np.int64), np.array(first, np.int64), np.array(splits, np.int64)))
    return out


def best(ids: np.ndarray, rows: np.ndarray, pick: np.ndarray, query: np.ndarray, rough: np.ndarray, reach: float,
         k: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of `pick` with the largest product, ties to the smaller id, each id once; `spare` rows repeat an id.

    `rough` holds single-precision products, `reach` bounds their error; what
    they leave in reach of the k-th place is ranked in double precision.
    """
    if len(pick) > k + spare:
        pick = pick[rough >= np.partition(rough, -k - spare)[-k - spare] - 2 * reach]
    exact = (rows[pick] * query).sum(axis=1)
    order = np.lexsort((ids[pick], -exact))
    if spare:
        order = order[np.sort(np.unique(ids[pick][order], return_index=True)[1])]
    order = order[:k]
    return ids[pick][order], exact[order]


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, tables: int = 4, functions: int = 5, width: float = 1.2,
           visits: int = 128, group_rows: int = 32_768, query_rows: int = 16_384, seed: int = 7) -> DataFrame:
    """The k nearest rows of `vectors` (id, vector) to each row whose id is divisible by `every`.

    Returns query_id, rank, vec_id, score. All rows are indexed. The driver
    holds one count per non-empty bucket; their number is bounded by the slots
    (`functions` directions of a few slots each) and not by the rows. A group
    is one task's work: at most `group_rows` vectors against at most
    `query_rows` queries; buckets beyond that are split by id and their
    queries visit every part, so a bucket with a third of all rows is spread.
    """
    names = vectors.columns
    source = vectors.select(F.col(names[0]).cast("long").alias("id"), F.col(names[1]).alias("vector"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flat, sizes = usable(batch, None)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
            squares = np.add.reduceat(np.square(flat), starts) if len(sizes) else np.zeros(0)
            good = np.isfinite(squares) & (squares > 0)
            yield pa.RecordBatch.from_arrays([pa.array(sizes[good].astype(np.int64)), pa.array(np.sqrt(squares[good]))],
                                             names=["length", "norm"])

    found = (source.mapInArrow(measure, "length long, norm double").groupBy("length")
             .agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), "length").first())
    spark = vectors.sparkSession
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, hashing = found["length"], Tables.draw(found["length"], found["norm"], tables, functions, width, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = matrix(batch, length)
            for table in range(tables):
                codes, n = np.unique(hashing.codes(table, rows), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), table, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))],
                    names=["table", "code", "n"])

    counted: dict[int, list[tuple[int, int]]] = {}
    for row in source.mapInArrow(count, "table int, code long, n long").groupBy("table", "code").agg(F.sum("n").alias("n")).collect():
        counted.setdefault(row["table"], []).append((row["code"], row["n"]))
    directories = plan_groups(counted, tables, group_rows)
    blocks = max(1, -(-found["n"] // (every * query_rows)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = matrix(batch, length)
            for table, known in enumerate(directories):
                codes = hashing.codes(table, rows)
                at = np.searchsorted(known.codes, codes)
                group = known.first[at] + (ids * 0x9E3779B1 >> 7) % known.splits[at]
                for block in range(blocks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(np.full(len(ids), block, np.int64)), pa.array(codes), pa.array(ids),
                         pa.array([r.tobytes() for r in rows], pa.binary())], names=["group", "block", "code", "id", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = matrix(batch, length)
            asked = ids % every == 0
            ids, rows = ids[asked], rows[asked]
            # A query may be scaled: its length does not change the order of products.
            unit = rows * (hashing.norm / np.sqrt(np.square(rows).sum(axis=1)))[:, None]
            for table, known in enumerate(directories):
                if not len(ids) or not len(known.codes):
                    continue
                out: list[tuple] = []
                slots = decode(known.codes, functions)
                for begin in range(0, len(ids), 256):
                    places = hashing.places(table, unit[begin:begin + 256])
                    for n, chosen in enumerate(probes(places, slots, known.sizes, visits, k + 1)):
                        by_group: dict[int, list[int]] = {}
                        for bucket in chosen:
                            for part in range(known.splits[bucket]):
                                by_group.setdefault(int(known.first[bucket]) + part, []).append(int(known.codes[bucket]))
                        query = int(ids[begin + n])
                        for group, codes in by_group.items():
                            out.append((group, query // every % blocks, query, rows[begin + n].tobytes(), codes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                    names=["group", "block", "id", "vector", "codes"])

    def scan(held: pa.Table, asking: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if held.num_rows and asking.num_rows:
            # rows alike in id and vector count once
            held = held.group_by(["code", "id", "vector"]).aggregate([])
            known, bucket = np.unique(held["code"].to_numpy(), return_inverse=True)
            ids = held["id"].to_numpy()
            spare = len(ids) - len(np.unique(ids))
            rows = np.frombuffer(b"".join(held["vector"].to_pylist()), np.float64).reshape(-1, length)
            single, reach = rows.astype(np.float32), 1e-5 * np.sqrt(np.square(rows).sum(axis=1).max())
            queries, wanted = asking["id"].to_numpy(), asking["codes"]
            for begin in range(0, len(queries), 256):
                part = np.frombuffer(b"".join(asking["vector"].slice(begin, 256).to_pylist()), np.float64).reshape(-1, length)
                products = part.astype(np.float32) @ single.T
                for n, vector in enumerate(part):
                    asked = np.zeros(len(known) + 1, bool)
                    asked[np.searchsorted(known, wanted[begin + n].values.to_numpy())] = True
                    query = queries[begin + n]
                    pick = np.flatnonzero(asked[bucket] & (ids != query))
                    if len(pick):
                        found_ids, scores = best(ids, rows, pick, vector, products[n][pick],
                                                 reach * np.sqrt(np.square(vector).sum()), k, spare)
                        out_q.append(np.full(len(found_ids), query, np.int64))
                        out_v.append(found_ids)
                        out_s.append(scores)
        empty = np.zeros(0, np.int64)
        return pa.table({"query_id": np.concatenate([empty, *out_q]), "vec_id": np.concatenate([empty, *out_v]),
                         "score": np.concatenate([np.zeros(0), *out_s])})

    held = source.mapInArrow(index, "group long, block long, code long, id long, vector binary").groupBy("group", "block")
    asking = source.where(F.col("id") % every == 0).mapInArrow(
        visit, "group long, block long, id long, vector binary, codes array<long>").groupBy("group", "block")
    near = held.cogroup(asking).applyInArrow(scan, "query_id long, vec_id long, score double")
    merged = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
