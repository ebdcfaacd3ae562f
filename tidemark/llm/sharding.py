"""Resharding by minimum-cost flow.

A sharded table is brought to new shard capacities with the fewest bytes
moved. Shards are made of blocks (documents with the same hash of the text, so
equal texts stay together); blocks are kept in files. The flow between shards
is solved on shard sizes alone, blocks are chosen to carry it, and only files
that lose a block are written again.

A null text has size 1 and an own block; an empty table gives empty shards;
repeated rows are kept; extra columns are not carried.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pieces
from tidemark.session import scratch_path


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all supplies within capacities: {(from, to): units}.

    Successive shortest paths with potentials over the shards; cost(i, j) >= 0
    per unit. Its size is the number of shards, not of rows. Raises ValueError
    when the capacities are too small.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities do not hold the supply")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, index of the reverse edge]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * len(graph)
    left = sum(supply)
    while left:
        far = [float("inf")] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and d + price + potential[a] - potential[b] < far[b]:
                    far[b], came[b] = d + price + potential[a] - potential[b], (a, k)
                    heapq.heappush(heap, (far[b], b))
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            a, k = came[at]
            path.append(graph[a][k])
            at = a
        units = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= units
            graph[e[0]][e[3]][1] += units
        left -= units
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i]
            if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def choose_blocks(blocks: list[tuple[int, int, int, int]], flow: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Blocks that carry the flow: {(shard, block): new shard}.

    `blocks` lists (shard, file, block, bytes). Whole files are drained one
    after the other, so few files are touched; what a leg still lacks is
    filled with the largest blocks that fit, to within the smallest block.
    """
    by_shard: dict[int, list[tuple[int, int, int]]] = {}
    for shard, file, block, size in blocks:
        by_shard.setdefault(shard, []).append((file, block, size))
    out = {}
    for shard, held in by_shard.items():
        held.sort(reverse=True)
        for (_, to), lacking in sorted((leg, units) for leg, units in flow.items() if leg[0] == shard and leg[1] != shard):
            while held and held[-1][2] <= lacking:
                _, block, size = held.pop()
                out[shard, block] = to
                lacking -= size
            by_size = sorted((size, block, file) for file, block, size in held)
            taken = set()
            while (n := bisect.bisect_right(by_size, (lacking, float("inf"))) - 1) >= 0:
                size, block, _ = by_size.pop(n)
                out[shard, block] = to
                taken.add(block)
                lacking -= size
            held = [h for h in held if h[1] not in taken]
    return out


@dataclass
class Layout:
    """A sharded table on disk: its folders, and which shard folders of each are still valid."""

    parts: list[tuple[str, Column | None]]

    def read(self, spark: SparkSession) -> DataFrame:
        out = None
        for path, valid in self.parts:
            df = spark.read.schema(SCHEMA).parquet(path)
            df = df if valid is None else df.where(valid)
            out = df if out is None else out.unionByName(df)
        return out


SCHEMA = "doc_id long, text string, unit long, block long, size long, shard int, file int"


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 plus one; 1 for null."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def block_of(text: Column, doc_id: Column, blocks: int) -> Column:
    """Equal texts share a block; rows without a text are dealt by id."""
    return F.pmod(F.when(text.isNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(text)), F.lit(blocks))


def write_shards(docs: DataFrame, path: str, shards: int, files: int, blocks: int, split_over: int,
                 capacity: int) -> Layout:
    """Writes (doc_id, text) as `shards` shards of `files` files, blocks dealt by number.

    Equal texts stay together unless they hold more than a shard (`capacity`).
    A block of more than `split_over` bytes is cut into units by text, a unit
    that is still larger (one text with very many copies) into blocks by id:
    these move together but lie in several files, so no task is bound to them.
    """
    text, doc_id = F.col("text"), F.col("doc_id")
    rows = docs.select(doc_id, text, block_of(text, doc_id, blocks).alias("_b"), size_of(text).alias("size"))

    def cut(held: DataFrame, by: str, over: str, key: Column, to: str) -> DataFrame:
        # At most total / split_over rows, whatever the input: 64 per shard as called below.
        large = held.groupBy(by).agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > split_over).select(
            F.col(by).alias("_large"), F.col("_bytes").alias(over), F.ceil(F.col("_bytes") / split_over).alias("_cuts"))
        part = F.coalesce(F.pmod(key, F.col("_cuts")), F.lit(0))
        named = F.when(part > 0, F.xxhash64(F.lit(to), by, part)).otherwise(F.col(by))
        return held.join(F.broadcast(large), F.col(by) == F.col("_large"), "left").withColumn(to, named).drop("_large", "_cuts")

    same = F.when(text.isNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(F.lit(5), text))
    held = cut(cut(rows, "_b", "_whole", same, "unit"), "unit", "_copies", F.xxhash64(F.lit(7), doc_id), "block")
    held = held.withColumn("unit", F.when(F.col("_copies") > capacity, F.col("block")).otherwise(F.col("unit")))
    cut_rows = held.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "unit"), F.lit(shards)).cast("int")).withColumn(
        "file", F.pmod(F.shiftright(F.xxhash64(F.lit(11), "block"), 20), F.lit(files)).cast("int"))
    cut_rows.select("doc_id", "text", "unit", "block", "size", "shard", "file").repartition(shards * files, "shard", "file").write.option(
        "compression", "zstd").partitionBy("shard", "file").parquet(path)
    return Layout([(path, None)])


def reshard(spark: SparkSession, old: Layout, shards: int, path: str) -> tuple[Layout, dict]:
    """Moves blocks between shards until all hold nearly the same bytes.

    Shard and block sizes are read from the written table; the driver holds
    one row per block (a number set by the block count, not by the rows).
    Only files that lose a block are written again, under `path`; the others
    stay. Returns the new layout and what the plan moved.
    """
    now = old.read(spark)
    places = [(r["shard"], r["file"], r["unit"], r["bytes"]) for r in
              now.groupBy("shard", "file", "unit").agg(F.sum("size").alias("bytes")).collect()]
    units: dict[tuple[int, int], tuple[int, int]] = {}  # of a unit: its first file and all its bytes
    for shard, file, unit, size in places:
        first, before = units.get((shard, unit), (file, 0))
        units[shard, unit] = min(first, file), before + size
    blocks = [(shard, file, unit, size) for (shard, unit), (file, size) in units.items()]
    held = [0] * (max([b[0] for b in blocks], default=0) + 1)
    for shard, _, _, size in blocks:
        held[shard] += size
    total = sum(held)
    capacity = [total // shards + (n < total % shards) for n in range(shards)]
    flow = min_cost_flow(held, capacity, lambda i, j: int(i != j))
    moved = choose_blocks(blocks, flow)
    touched = sorted({(s, f) for s, f, b, _ in places if (s, b) in moved})
    stats = {"total": total, "flow": {k: v for k, v in flow.items() if k[0] != k[1]}, "blocks": len(moved), "files": len(touched)}
    if not moved:
        return old, stats
    plan = spark.createDataFrame([(s, b, to) for (s, b), to in moved.items()], "_s int, _b long, _to int")
    hit = F.concat_ws("/", "shard", "file").isin([f"{s}/{f}" for s, f in touched])
    rewritten = now.where(F.col("shard").isin(sorted({s for s, _ in touched}))).where(hit).join(
        plan, (F.col("shard") == F.col("_s")) & (F.col("unit") == F.col("_b")), "left")
    rewritten = rewritten.withColumn("shard", F.coalesce("_to", "shard")).drop("_s", "_b", "_to")
    # Each task splits the files it read: the moved rows need no exchange.
    rewritten.write.option("compression", "zstd").partitionBy("shard", "file").parquet(path)
    kept = [(p, ~hit if valid is None else valid & ~hit) for p, valid in old.parts]
    return Layout([*kept, (path, None)]), stats


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot, the place within the shard, gapless from 0.

    Blocks are counted first; a running sum over a shard's blocks and a
    running number within each block give the place, so no task sees a shard.
    """
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_s"), F.col("block").alias("_b"),
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(starts, (F.col("shard") == F.col("_s")) & (F.col("block") == F.col("_b"))).withColumn(
        "slot", F.col("_start") + F.col("_k")).drop("_s", "_b", "_start", "_k")


def shard_documents(spark: SparkSession, docs: DataFrame, *, old_shards: int = 7, shards: int = 8, files: int = 8,
                    file_bytes: int = 256 << 20, blocks_per_shard: int = 512, block_bytes: int = 128 << 20) -> DataFrame:
    """The documents in `old_shards` hash shards, then brought to `shards` equal ones.

    Returns doc_id, size, text_crc32, block, shard and slot as read back from
    the files. There are `blocks_per_shard` blocks per shard, more when they
    would hold over `block_bytes`, and `files` files per old shard, more when
    they would hold over `file_bytes`.
    """
    total = docs.select(F.sum(size_of(F.col("text")))).first()[0]
    blocks = shards * max(blocks_per_shard, pieces(total, block_bytes * shards))
    files = max(files, pieces(total, file_bytes * old_shards))
    root = scratch_path(spark, "shards")
    old = write_shards(docs, f"{root}/old", old_shards, files, blocks, max(1, (total or 0) // (shards * 64)),
                       max(1, (total or 0) // shards))
    new, _ = reshard(spark, old, shards, f"{root}/new")
    rows = new.read(spark).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "block", "shard")
    return with_slots(rows)
