"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of PLACES values of 16 bits.
Two signatures that differ in at most `distance` places agree but for one place
in at least one of CHUNKS chunks (pigeonhole: distance < 2 * CHUNKS), so the
chunks, each with one place left out in turn, are the keys under which all
pairs within the distance meet. Links are confirmed on the full sets.

At a similarity of 0.8 a place differs with probability 0.2; that more than 31
of 64 do has a probability of 2e-7.

Documents with equal sets are one node. Buckets are not paired out: members
meet their bucket's leaders first, in large ones other leaders while that joins
many; what is then in one component needs no more tests, and only members of
different components that share a bucket are compared further, all of them,
in pairs of bounded blocks. Documents without words are linked with nothing, nor are rows
without an id; repeated rows and ids are nodes by their sets; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import near, pieces, slices, text_key
from tidemark.llm.components import components
from tidemark.session import cut_lineage

PLACES, CHUNKS = 64, 16
WIDTH = PLACES // CHUNKS
DISTANCE = 2 * CHUNKS - 1
SKETCH = 1024  # bits of a parity sketch
MARK = np.dtype([("places", np.uint16, PLACES), ("size", np.int64), ("sketch", np.uint64, SKETCH // 64)])
LEADERS = 2
MANY = 1000  # components in a bucket that are worth another turn of leaders
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter text is one n-gram as a whole."""
    known, out = WordHashes(), []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        if len(known) > 500_000:
            known.clear()
        hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        n = min(words, len(tokens))
        if not n:
            out.append(hashes)
            continue
        # the length goes in, as a short sequence is no prefix of a longer one
        total = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            total = mix(total * GOLD + hashes[k:len(hashes) - n + 1 + k])
        out.append(np.unique(total))
    return out


def multipliers(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, PLACES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, PLACES, np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PLACES 16-bit values per set; rows of empty sets are zero."""
    out = np.zeros((len(sets), PLACES), np.uint16)
    full = [n for n, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[n] for n in full])
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0] + [len(sets[n]) for n in full[:-1]])
    for place, (a, b) in enumerate(zip(*multipliers(), strict=True)):
        mixed = (flat ^ b) * a
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(mixed, starts)
        out[full, place] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The PLACES keys of each signature: every chunk with every one of its places left out."""
    out = np.empty((len(signature), PLACES), np.uint64)
    for chunk in range(CHUNKS):
        part = signature[:, chunk * WIDTH:(chunk + 1) * WIDTH].astype(np.uint64)
        for left_out in range(WIDTH):
            key = np.full(len(part), chunk * WIDTH + left_out + 1, np.uint64)
            for place in range(WIDTH):
                if place != left_out:
                    key = mix(key * GOLD + part[:, place])
            out[:, chunk * WIDTH + left_out] = key
    return out


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, signature) of every row of (doc_id, text, key); node is a hash of the whole set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array([r.tobytes() for r in signatures(sets)], pa.binary())],
                names=["doc_id", "key", "n_shingles", "node", "signature"])

    return docs.mapInArrow(work, "doc_id long, key long, n_shingles long, node long, signature binary")


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Batches of rows sorted by key, each followed by the places where its runs begin; the first may go on from before."""
    for batch in batches:
        if batch.num_rows:
            held = {c: batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in columns}
            yield held, np.flatnonzero(np.concatenate([[True], held["key"][1:] != held["key"][:-1]]))


def shared_keys(nodes: DataFrame, parts: int) -> DataFrame:
    """(key, node) of all keys that two nodes share, and for each member up to LEADERS members before it.

    Rows stream by in key order; of a bucket only its first members are held,
    so its size does not matter to a task's memory.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                some = batch.slice(begin, 2000)
                rows = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(-1, PLACES)
                node = some.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(rows).view(np.int64).ravel()), pa.array(np.repeat(node, PLACES))],
                                                 names=["key", "node"])

    keyed = nodes.select("node", "signature").mapInArrow(expand, "key long, node long")
    return starred(keyed.repartition(parts, "key").sortWithinPartitions("key", "node"))


def starred(ordered: DataFrame) -> DataFrame:
    """(key, node, leaders) of rows (key, node) that come sorted by key; keys of a single row are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, single = None, [], False
        for held, begins in runs(batches, ["key", "node"]):
            ends = np.append(begins[1:], len(held["key"]))
            out_key, out_node, out_leaders = [], [], []
            # most runs are single rows that nothing follows
            loose = ends - begins == 1
            loose[[0, -1]] = False
            for begin, end in zip(begins[~loose], ends[~loose], strict=True):
                own = int(held["key"][begin])
                if own != key:
                    key, leaders, single = own, [], False
                for node in held["node"][begin:end].tolist():
                    if not leaders:
                        single = True
                        leaders.append(node)
                        continue
                    if single:
                        out_key.append(own)
                        out_node.append(leaders[0])
                        out_leaders.append([])
                        single = False
                    out_key.append(own)
                    out_node.append(node)
                    out_leaders.append(list(leaders))
                    if len(leaders) < LEADERS:
                        leaders.append(node)
            if out_key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_key, pa.int64()), pa.array(out_node, pa.int64()), pa.array(out_leaders, pa.list_(pa.int64()))],
                    names=["key", "node", "leaders"])

    return ordered.select("key", "node").mapInArrow(work, "key long, node long, leaders array<long>")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have `percent` of their union in common."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def marks_of(sets: DataFrame) -> DataFrame:
    """(node, mark) of `sets` (node, signature, set): signature, size and parity sketch of each set in one binary value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set"):
            marks = np.zeros(batch.num_rows, MARK)
            for mark, signature, held in zip(marks, batch.column(1), batch.column(2), strict=True):
                hashes = np.frombuffer(held.as_buffer(), np.uint64)
                mark["places"] = np.frombuffer(signature.as_buffer(), np.uint16)
                mark["size"] = len(hashes)
                mark["sketch"] = np.frombuffer(sketch(hashes), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in marks], pa.binary())], names=["node", "mark"])

    return sets.select("node", "signature", "set").mapInArrow(work, "node long, mark binary")


def sketch(hashes: np.ndarray) -> bytes:
    """Whether an even or odd number of hashes falls on each of SKETCH bits."""
    bits = np.bincount((hashes >> np.uint64(24)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def read_marks(column: list) -> np.ndarray:
    return np.frombuffer(b"".join(column), MARK)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which marks lie within the signature distance and may belong to sets that share `percent` of their union.

    No link is lost here: sets that are linked differ in at most
    (100 - percent) / (100 + percent) of their sizes' sum, and parity
    sketches in no more bits than that.
    """
    close = (x["places"] != y["places"]).sum(axis=1) <= DISTANCE
    close &= 100 * np.minimum(x["size"], y["size"]) >= percent * np.maximum(x["size"], y["size"])
    at = np.flatnonzero(close)
    one, other = (v if len(v) == 1 else v[at] for v in (x, y))
    apart = np.bitwise_count(one["sketch"] ^ other["sketch"]).sum(axis=1, dtype=np.int64)
    close[at] = apart * (100 + percent) <= (100 - percent) * (one["size"] + other["size"])
    return close


def close_pairs(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) of nodes whose marks are alike, with the distance of their signatures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (read_marks(batch.column(k).to_pylist()) for k in (2, 3))
            kept = np.flatnonzero(alike(x, y, percent))
            distance = (x["places"][kept] != y["places"][kept]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)),
                                              pa.array(distance, pa.int64())], names=["a", "b", "distance"])

    def side(name: str) -> DataFrame:
        return marks.select(F.col("node").alias(f"_{name}"), F.col("mark").alias(f"_mark_{name}"))

    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "_mark_a", "_mark_b").mapInArrow(work, "a long, b long, distance long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that lie within the similarity on full sets; only pairs with marks alike should come here."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            kept = [n for n in range(batch.num_rows) if similar(
                *(np.frombuffer(c[n].as_buffer(), np.uint64) for c in (left, right)), percent)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int32())) for c in batch.columns[:2]], names=["a", "b"])

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(f"_{name}"), F.col("set").alias(f"_set_{name}"))

    joined = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return joined.select("a", "b", "_set_a", "_set_b").mapInArrow(work, "a long, b long")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def undecided(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """(key, node, component, leader) of the members of buckets that still hold more than one component.

    `leader` is the (node, component) that the members of the bucket are to
    be compared with in this turn.
    """
    placed = members.select("key", "node").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy(F.col("key").alias("_key")).agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"),
        F.min_by(F.struct("node", "component"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("leader"))
    mixed = mixed.where((F.col("_low") < F.col("_high")) & (F.col("_n") > LEADERS + 1)).select("_key", "leader")
    return placed.join(mixed, F.col("key") == F.col("_key")).drop("_key")


def first_shared(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The first of the keys `own` that each row of `keys` shares."""
    return own[(keys == own).argmax(axis=1)]


def met(key: int, component: np.ndarray, home: np.ndarray, mark: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of one task of a bucket that lie in different components and have marks alike.

    A pair is told under the first key that it shares only. The rows are of
    one block, or of two whose own pairs meet elsewhere; `component` may
    change between two rows.
    """
    keys = keys_of(mark["places"]).view(np.int64)
    across = home[0] != home[-1]
    for n in range(len(mark) - 1):
        # rows come by block, so of two blocks the second is what later rows differ in
        later = np.flatnonzero((component[n + 1:] != component[n]) & (not across or home[n + 1:] != home[n])) + n + 1
        later = later[alike(mark[n:n + 1], mark[later], percent)]
        if len(later):
            later = later[first_shared(keys[later], keys[n]) == key]
        if len(later):
            yield n, later


def linked_within(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between components among (key, node, component, home, mark, set) of one task of a bucket.

    What a link joins needs no further test between its parts.
    """
    node, component, home = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    out = []
    for n, later in met(rows[0][0], component, home, read_marks([r[4] for r in rows]), percent):
        for m in later:
            if component[m] != component[n] and similar(sets[n], sets[m], percent):
                out.append((int(node[n]), int(node[m])))
                component[component == component[m]] = component[n]
    return out


def met_within(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """(key, node) of the rows (key, node, component, home, mark) of one task of a bucket that have a pair to test."""
    node, component, home = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    wanted = np.zeros(len(rows), bool)
    for n, later in met(rows[0][0], component, home, read_marks([r[4] for r in rows]), percent):
        wanted[n] = True
        wanted[later] = True
    return [(rows[0][0], n) for n in node[wanted].tolist()]


def in_block_pairs(members: DataFrame, size: Column, block: int, work: Callable[[list[tuple]], list[tuple]], names: tuple[str, str]) -> DataFrame:
    """What `work` gives for the rows of each task of `members` (key, node, component, ...).

    The members of a bucket are dealt to blocks that hold about `block` of
    `size`, and every two blocks meet in one task, which holds no more than
    these two; smaller buckets come one after the other.
    """
    sized = members.withColumn("_size", size)
    buckets = sized.groupBy(F.col("key").alias("_key")).agg(F.sum("_size").alias("_total"), F.count("*").alias("_n"))
    buckets = cut_lineage(buckets.select("_key", "_n", F.ceil(F.col("_total") / block).cast("int").alias("_blocks")).where(F.col("_n") > 1))
    told = buckets.agg(F.sum(F.col("_n") * F.col("_blocks")), F.sum(F.col("_n") * F.col("_n")), F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2)).first()
    # as many parts as rows or comparisons ask for, and no more than there are tasks
    parts = max(pieces(told[0], 50_000), min(pieces(told[1], 20_000_000), int(told[2] or 1)))
    home = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    placed = members.join(near(buckets, F.lit(24)), F.col("key") == F.col("_key")).withColumn("home", home)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("other")
    columns = ["key", "node", "component", "home", *[c for c in members.columns if c not in ("key", "node", "component")]]
    dealt = placed.select(*columns, other).withColumn("low", F.least("home", "other")).withColumn("high", F.greatest("home", "other"))
    ordered = dealt.drop("other").repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "home", "node")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2 or at[1] != at[2] and held[0][3] == held[-1][3]:
                return
            if found := work(held):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=list(names))

        for batch in batches:
            listed = [[v.as_buffer() for v in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
            for row in zip(*listed, strict=True):
                if (task := (row[0], *row[-2:])) != at:
                    yield from done()
                    at, held = task, []
                held.append(row[:-2])
        yield from done()

    return ordered.mapInArrow(stream, ", ".join(f"{n} long" for n in names))


def remaining_links(left: DataFrame, sets: DataFrame, percent: int, block_bytes: int = 32 << 20, block_rows: int = 8192) -> DataFrame:
    """Links (a, b) among documents that share a bucket and lie in different components.

    Buckets are taken one by one, in pairs of blocks. Marks go first: only
    members with a pair whose marks are alike, under the first key it shares,
    bring their sets to the bucket.
    """
    marks = cut_lineage(marks_of(sets).withColumnRenamed("node", "_node"))
    members = left.select("key", "node", "component").join(marks, F.col("node") == F.col("_node")).drop("_node")
    close = cut_lineage(in_block_pairs(members, F.lit(1), block_rows, lambda rows: met_within(rows, percent), ("key", "node")).distinct())
    placed = left.select(F.col("node").alias("_member"), "component").distinct()
    whole = marks.join(sets.select("node", "set"), F.col("node") == F.col("_node")).select("_node", "mark", "set")
    wanted = close.join(placed, F.col("node") == F.col("_member")).join(whole, F.col("node") == F.col("_node")).select(
        "key", "node", "component", "mark", "set")
    size = F.octet_length("set") + MARK.itemsize + 64
    return in_block_pairs(wanted, size, block_bytes, lambda rows: linked_within(rows, percent), ("a", "b"))


def led_again(left: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of members with the nearest of the leaders that the buckets have in this turn; one test a member at most."""
    pairs = left.where(F.col("component") != F.col("leader.component")).select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct()
    nearest = close_pairs(pairs, marks, percent).groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
    return confirm(nearest.select(*_pair("a", "b")).distinct(), sets, percent)


def without_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which one document of each group of near-duplicates stays.

    What goes is listed by id and text and taken out by an anti join; of rows
    alike in both one stays. Rows without an id stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"), row.alias("row"))
    told = cut_lineage(near_duplicates(docs.select("doc_id", "text"), words=words, percent=percent))
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    left = held.join(near(gone, F.lit(16)), same, "left_anti")
    twice = told.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    twice = cut_lineage(twice.drop("_n"))
    if not twice.isEmpty():
        once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "key"])
        left = left.join(twice, same, "left_anti").unionByName(once)
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, *, words: int, percent: int = 80) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept of every row of `docs` (doc_id, text); key is a hash of the text.

    Linked are documents whose sets of `words`-word shingles have at least
    `percent` of their union in common. Only sets of documents that share a
    key with another are moved, once; between rounds everything is
    checkpointed, so a lost executor costs one step.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    signed = cut_lineage(sign(docs, words))
    nodes = cut_lineage(signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("first"), F.min("signature").alias("signature")))
    parts = pieces(nodes.count() * PLACES, 1_000_000)
    members = cut_lineage(shared_keys(nodes, parts))
    wanted = members.select(F.col("node").alias("_node")).distinct()
    listed = nodes.join(wanted, F.col("node") == F.col("_node")).select("_node", F.col("first").alias("_first"), "signature")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_64_intdigest(s) >> 1 for s in sets], pa.int64()), pa.array(sets, pa.binary())],
                names=["doc_id", "node", "set"])

    narrow = near(listed.select("_node", "_first"), F.lit(16))
    sets = docs.mapInArrow(whole, "doc_id long, node long, set binary").join(
        narrow, (F.col("node") == F.col("_node")) & (F.col("doc_id") == F.col("_first"))).select("node", "set")
    sets = sets.join(listed.select("_node", "signature"), F.col("node") == F.col("_node")).select("node", "signature", "set")
    sets = cut_lineage(sets.dropDuplicates(["node"]))

    tested = members.select("node", F.explode("leaders").alias("leader")).select(*_pair("node", "leader")).distinct()
    marks = cut_lineage(marks_of(sets))
    links = cut_lineage(confirm(close_pairs(tested, marks, percent).select("a", "b"), sets, percent))
    found = components(links)
    turn = 1
    left = cut_lineage(undecided(members, found, turn))
    # Large groups of copies that the leaders are not of: other leaders, as long as they join many.
    while left.groupBy("key").agg(F.countDistinct("component").alias("n")).where(F.col("n") > MANY).limit(1).count():
        more = cut_lineage(led_again(left, marks, sets, percent))
        links = cut_lineage(links.unionByName(more))
        if 20 * more.count() < left.select("node").distinct().count():
            break  # what has been joined needs no more tests, but goes through them
        turn += 1
        found = components(links)
        left = cut_lineage(undecided(members, found, turn))
    if not left.isEmpty():
        links = cut_lineage(links.unionByName(remaining_links(left, sets, percent)))
        found = components(links)
    placed = nodes.select("node", "first").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", "first", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "_component")
    answer = placed.join(least, F.col("component") == F.col("_component")).select(F.col("node").alias("_node"), "component_id")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("node") == F.col("_node"))
    own = F.coalesce("component_id", "doc_id")
    return signed.join(answer, linked, "left").select(
        "doc_id", "key", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
