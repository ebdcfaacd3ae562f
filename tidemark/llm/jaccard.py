"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows and word n-grams columns of an incidence matrix; the product
of the matrix with its transpose holds the overlap of every two documents. It
is never formed whole. Equal sets are one row, and what follows from sizes alone
leaves rows and columns out, without losing a link:

* of two linked sets, at most `spare` grams of one lie outside the other, so a
  document with more grams that nothing else holds is linked with nothing; this
  is told from the grams of one part in SHARE of all hashes;
* two linked sets share one of their first `spare + 1` grams in any common
  order; grams that many documents hold come last in it;
* the number of bits in which two parity sketches differ is at most the number
  of grams in which the sets do, so documents of a column that are too far
  apart are told from sketches.

What is left falls into groups. A group is cut into blocks of rows, and every
two blocks are multiplied in one task, over slices of the columns that two rows
share at least: overlaps add up, pairs below the bound that their sizes set are
discarded, and each row's links are counted. Only counts and the links that
join a task's documents leave it, not all pairs.

A text with fewer words than n is one gram as a whole; a null text, a text
without words, or a row without an id is linked with nothing. Repeated rows are
copies of one set and linked with each other. An empty table gives no rows.
Very long texts are one row of the matrix, in a block of their own. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import near, pieces, slices
from tidemark.llm.components import components
from tidemark.llm.neardups import shingle_sets
from tidemark.session import cut_lineage, scratch_path

SHARE = 4
SKETCH = 1024  # bits
OFTEN = 64  # a gram that more sets hold comes last
MOST_OFTEN = 500_000  # grams that are told apart as frequent, whatever the corpus
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
SLICE = 4096  # columns multiplied at once


def spare(size: int, percent: int) -> int:
    """Grams that one of two linked sets has beside the other."""
    return (100 - percent) * size // 100


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, part) of every row of (doc_id, text): a hash of the whole set, and its grams in the chosen part of the hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            parts = [s[s % np.uint64(SHARE) == 0].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([name(s) for s in sets], pa.int64()), lists(parts)],
                names=["doc_id", "n_shingles", "node", "part"])

    return docs.mapInArrow(work, "doc_id long, n_shingles long, node long, part array<long>")


def name(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def unlisted(column: pa.ListArray) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().to_numpy())
    return np.split(column.flatten().to_numpy().view(np.uint64), ends[:-1]) if len(ends) else []


def candidates(signed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, first) of the sets that do not hold too many grams of their own."""
    grams = signed.select("node", F.explode("part").alias("gram")).groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("_last"))
    own = grams.where(F.col("node") == F.col("_last")).groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("_own"))
    joined = nodes.join(own, F.col("node") == F.col("_node"), "left")
    return joined.where(100 * F.coalesce("_own", F.lit(0)) <= (100 - percent) * F.col("n_shingles")).select("node", "first")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, size, grams) of each of `wanted` (node, first), one row per node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 lists([s.view(np.int64) for s in sets])], names=["_node", "node", "size", "grams"])

    # a row is kept under the node it was chosen for; rows may share an id
    asked = near(wanted.select(F.col("node").alias("_node"), "first"), F.lit(16))
    found = docs.join(asked, F.col("doc_id") == F.col("first")).select("text", "_node").mapInArrow(
        work, "_node long, node long, size long, grams array<long>")
    return found.where(F.col("_node") == F.col("node")).drop("_node").dropDuplicates(["node"])


def often(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gram, sets that hold it) of the frequent grams, by gram; MOST_OFTEN at most, as a gram counts from the total by that number."""
    least = max(OFTEN, (sets.agg(F.sum("size")).first()[0] or 0) // MOST_OFTEN)
    rows = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    grams = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r["n"] for r in rows], np.int64)[order]


def sketch(grams: np.ndarray) -> bytes:
    """Whether an even or odd number of grams falls on each bit."""
    bits = np.bincount((grams >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def first_grams(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, size, sketch) of the grams of each set of which two linked sets share one."""
    common, holding = often(sets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for begin in range(0, big.num_rows, 500):
                batch = big.slice(begin, 500)
                chosen, sketches = [], []
                for grams in unlisted(batch.column(2)):
                    length = spare(len(grams), percent) + 1
                    at = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
                    frequent = common[at] == grams if len(common) else np.zeros(len(grams), bool)
                    some = grams[~frequent][:length]
                    if len(some) < length:
                        last = np.flatnonzero(frequent)
                        last = last[np.argsort(holding[at[last]], kind="stable")]
                        some = np.concatenate([some, grams[last[:length - len(some)]]])
                    chosen.append(some)
                    sketches.append(sketch(grams))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(chosen).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(sketches, pa.binary()).take(rows)], names=["gram", "node", "size", "sketch"])

    return sets.select("node", "size", "grams").mapInArrow(work, "gram long, node long, size long, sketch binary")


def in_blocks(rows: DataFrame, key: str, nbytes: Column, work: Callable[[list[list]], tuple | None], schema: str) -> DataFrame:
    """What `work` makes of the columns of every task of `rows` (key, node, size, ...).

    The rows of a key are dealt to blocks of about BLOCK_BYTES and BLOCK_ROWS,
    and every two blocks of a key meet in one task; keys of one row go. Rows
    of a task come by block and size, with the block as last column; small
    keys share partitions, one after the other.
    """
    own = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(nbytes).alias("_bytes"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK_ROWS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("long")
    own = cut_lineage(own.select("_key", "_bytes", blocks.alias("_blocks")))
    parts = pieces(own.agg(F.sum(F.col("_bytes") * F.col("_blocks"))).first()[0], 32 << 20)
    joined = rows.join(near(own.drop("_bytes"), F.lit(16)), F.col(key) == F.col("_key"))
    joined = joined.withColumn("_home", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    dealt = joined.select(*rows.columns, "_home", other).withColumns(
        {"_low": F.least("_home", "_other"), "_high": F.greatest("_home", "_other")})
    ordered = dealt.drop("_other").repartition(parts, key, "_low", "_high").sortWithinPartitions(key, "_low", "_high", "_home", "size", "node")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, filled = None, []

        def done(task: list[pa.RecordBatch]) -> None:
            told = pa.Table.from_batches(task).combine_chunks().to_batches()
            if told and told[0].num_rows > 1 and (found := work([*told[0].columns[1:-2]])) is not None:
                filled.append(found)

        def flush() -> Iterator[pa.RecordBatch]:
            if filled:
                columns = [np.concatenate(c) for c in zip(*filled, strict=True)]
                filled.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            told = np.stack([batch.column(0).to_numpy(), *(batch.column(c).to_numpy() for c in (-2, -1))])
            edges = [0, *(np.flatnonzero((told[:, 1:] != told[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                task = tuple(told[:, begin].tolist())
                if task != at and held:
                    done(held)
                    held = []
                at = task
                held.append(batch.slice(begin, end - begin))
            if sum(len(f[0]) for f in filled) > 50_000:
                yield from flush()
        if held:
            done(held)
        yield from flush()

    return ordered.mapInArrow(stream, schema)


def near_by_sketch(columns: list[pa.Array], percent: int) -> tuple | None:
    """Pairs (a, b) that join the rows of one column of the matrix whose sketches allow a link; what is joined is not told again."""
    node, size, home = (columns[k].to_numpy() for k in (0, 1, 3))
    sketches = np.frombuffer(b"".join(columns[2].to_pylist()), np.uint64).reshape(len(node), -1)
    across = home[0] != home[-1]
    group = np.arange(len(node))
    a, b = [], []
    for n in range(len(node) - 1):
        other = group[n + 1:] != group[n]
        if across:
            other &= home[n + 1:] != home[n]
        later = np.flatnonzero(other) + n + 1
        if not len(later):
            continue
        small, large = np.minimum(size[later], size[n]), np.maximum(size[later], size[n])
        later = later[100 * small >= percent * large]
        apart = np.bitwise_count(sketches[later] ^ sketches[n]).sum(axis=1, dtype=np.int64)
        later = later[(100 + percent) * apart <= (100 - percent) * (size[later] + size[n])]
        if len(later):
            joined, first = np.unique(group[later], return_index=True)
            a += [node[n]] * len(first)
            b += node[later[first]].tolist()
            group[np.isin(group, joined)] = group[n]
    return (np.array(a, np.int64), np.array(b, np.int64)) if a else None


def overlaps(rows: list[np.ndarray], split: int) -> np.ndarray:
    """The product of the rows before `split` with those from it on (with themselves, if split is 0), by slices of columns."""
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    kind = np.float32 if max(map(len, rows)) < 1 << 24 else np.float64
    left, right = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    total = np.zeros((len(rows[left]), len(rows[right])), kind)
    for begin in range(0, int(shared.sum()), SLICE):
        first, last = np.searchsorted(column, (begin, begin + SLICE))
        part = np.zeros((len(rows), min(SLICE, int(shared.sum()) - begin)), kind)
        part[row[first:last], column[first:last] - begin] = 1
        total += part[left] @ part[right].T
    return total


def linked(columns: list[pa.Array], percent: int) -> tuple | None:
    """(node, other, links) of one task: rows (node, -1, documents that it is linked with), and links (a, b, 0) that join all rows that are linked."""
    node, size, copies, home = (columns[k].to_numpy() for k in (0, 1, 3, 4))
    rows = unlisted(columns[2])
    split = int(np.searchsorted(home, home[-1])) if home[0] != home[-1] else 0
    common = overlaps(rows, split).astype(np.int64)
    left, right = (np.arange(split), np.arange(split, len(rows))) if split else (np.arange(len(rows)),) * 2
    links = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    if not split:
        np.fill_diagonal(links, False)
    degree = np.zeros(len(rows), np.int64)
    degree[left] += links @ copies[right]
    if split:
        degree[right] += links.T @ copies[left]
    some = np.flatnonzero(degree)
    if not len(some):
        return None
    group = np.arange(len(rows))
    a, b = [], []
    for n in np.flatnonzero(links.any(axis=1)):
        others = right[links[n]]
        joined, first = np.unique(group[others], return_index=True)
        fresh = joined != group[left[n]]
        if fresh.any():
            a += [node[left[n]]] * int(fresh.sum())
            b += node[others[first[fresh]]].tolist()
            group[np.isin(group, joined)] = group[left[n]]
    return (np.concatenate([node[some], np.array(a, np.int64)]), np.concatenate([np.full(len(some), -1), np.array(b, np.int64)]),
            np.concatenate([degree[some], np.zeros(len(a), np.int64)]))


def join(docs: DataFrame, *, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of `docs` (doc_id, text).

    `n_links` is the number of other documents linked with this one, copies
    included. Texts are read twice, the second time those that may have links.
    What moves: a part of the grams, the first grams of sets that may have
    links, and these sets, once per block of their group. Every step is
    written to the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "grams")
    sign(docs, words).write.parquet(path)
    signed = spark.read.parquet(path)
    taking_part = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = cut_lineage(taking_part.groupBy("node").agg(
        F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    wanted = cut_lineage(candidates(taking_part, nodes, percent))
    path = scratch_path(spark, "sets")
    whole_sets(docs, wanted, words).write.parquet(path)
    sets = spark.read.parquet(path)

    path = scratch_path(spark, "first-grams")
    first_grams(sets, percent).write.parquet(path)
    edges = in_blocks(spark.read.parquet(path), "gram", F.lit(SKETCH // 8 + 32), lambda c: near_by_sketch(c, percent), "a long, b long")
    groups = components(edges).select(F.col("node").alias("_node"), F.col("component").alias("group"))
    count = nodes.select(F.col("node").alias("_of"), "copies")
    members = sets.join(groups, F.col("node") == F.col("_node")).join(count, F.col("node") == F.col("_of")).select(
        "group", "node", "size", "grams", "copies")
    path = scratch_path(spark, "groups")
    members.write.parquet(path)
    members = spark.read.parquet(path)
    told = cut_lineage(in_blocks(members, "group", 8 * F.col("size") + 64, lambda c: linked(c, percent), "node long, other long, links long"))

    found = components(told.where(F.col("other") >= 0).select(F.col("node").alias("a"), F.col("other").alias("b")))
    degree = told.where(F.col("other") < 0).groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    placed = nodes.join(found.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left").select(
        "node", "first", "copies", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("component_id"), F.sum("copies").alias("_all"))
    # documents that are alone need no answer
    answer = cut_lineage(placed.join(least.where(F.col("_all") > 1), F.col("component") == F.col("_c")).join(
        degree, F.col("node") == F.col("_n"), "left").select(
        F.col("node").alias("_node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked_rows = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("node") == F.col("_node"))
    return signed.join(near(answer, F.lit(24)), linked_rows, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
