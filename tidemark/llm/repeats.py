"""Repeated passages by the interval tree of an enhanced suffix array.

Strings of `length` bytes that start at two places are found without comparing
all suffixes: every such string holds the same anchor (the ANCHOR-gram with
the least hash in it) at the same offset, so only suffixes at anchors that
occur more than once are sorted, each with the context a string around it can
reach. A scan of the sorted suffixes with a stack gives the tree of common
prefix intervals; the left contexts of an interval's members tell how far its
repeats extend to the left and where they differ, which gives the maximal
repeats with all their occurrences.

Texts are UTF-8 bytes, matches never cross documents, and equal texts are
looked at once: such a text repeats as a whole. Null and empty texts and texts
shorter than `length` hold no repeat. Text identity is a 64-bit hash. Repeated
rows are copies like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, near, pieces, slices, text_key
from tidemark.session import cut_lineage

LENGTH = 200
ANCHOR = 64
LEFT = LENGTH - ANCHOR  # bytes before an anchor that a string can reach
SEGMENT = 900_000  # bytes looked at in one go, below 2 ** PLACE_BITS
PLACE_BITS = 20
BASE = 0x9E3779B97F4A7C15 | 1


class Rolling:
    """Hashes of all ANCHOR-grams of an array of bytes, by powers of an odd base modulo 2**64; also of longer strings."""

    def __init__(self, most: int):
        def powers(base: int) -> np.ndarray:
            return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, base, np.uint64)]), dtype=np.uint64)

        self.power, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def hashes(self, data: np.ndarray, length: int = ANCHOR) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * self.power[:len(data)], out=total[1:])
        out = (total[length:] - total[:-length]) * self.inverse[:len(data) - length + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def anchors(texts: list[bytes], rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place in it, hash) of the anchors of all strings of LENGTH bytes."""
    segments = [(n, begin) for n, text in enumerate(texts) for begin in range(0, max(1, len(text) - LENGTH + 1), SEGMENT)
                if len(text) >= LENGTH]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, int]] = []
    filled = 0

    def look() -> None:
        parts = [texts[n][begin:begin + SEGMENT + LENGTH - 1] for n, begin in held]
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(parts), np.uint8)
        hashes = rolling.hashes(data)
        # The leftmost of equal hashes wins; equal strings agree on that.
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width, goal = 1, LEFT + 1
        while width * 2 <= goal:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < goal:
            least = np.minimum(least[:-(goal - width)], least[goal - width:])
        usable = np.zeros(len(data) + 1, np.int32)
        usable[starts] += 1
        usable[starts + sizes - LENGTH + 1] -= 1
        inside = np.cumsum(usable)[:len(least)] > 0
        place = np.unique((least[inside] & low).astype(np.int64))
        of = np.searchsorted(starts, place, side="right") - 1
        number, begin = np.array(held).T
        out.append((number[of], place - starts[of] + begin[of], hashes[place]))

    for n, begin in segments:
        size = min(len(texts[n]) - begin, SEGMENT + LENGTH - 1)
        if held and filled + size > SEGMENT + LENGTH:
            look()
            held, filled = [], 0
        held.append((n, begin))
        filled += size
    if held:
        look()
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([e, *(o[k] for o in out)]) for k, e in enumerate((empty, empty, empty.astype(np.uint64))))


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """(key, place) of the anchors that occur at more than one place of the distinct texts.

    Anchors stream by in the order of their hashes; of an anchor that very
    many documents share one row is held at a time.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(SEGMENT + 2 * LENGTH)
        for batch in slices(batches, "text", 4_000_000):
            names = batch.schema.names
            texts = [(t or "").encode() for t in batch.column(names.index("text")).to_pylist()]
            number, place, hashes = anchors(texts, rolling)
            key = batch.column(names.index("key")).to_numpy()[number]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(key), pa.array(place)],
                                             names=["anchor", "key", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, False  # the row before; whether it has met no other yet
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            fresh = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])  # copies of a text count once
            rows = rows[:, fresh]
            same = rows[0, 1:] == rows[0, :-1]
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last is not None:
                met[0] = waiting and met[0]  # told before, unless it was waiting
            waiting = (waiting or last is None) if len(same) == 0 else not same[-1]
            last = rows[:, -1]
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[1, met]), pa.array(rows[2, met])], names=["key", "place"])

    found = docs.mapInArrow(find, "anchor long, key long, place long")
    ordered = found.repartition(parts, "anchor").sortWithinPartitions("anchor", "key", "place")
    return ordered.mapInArrow(meet, "key long, place long")


def contexts(docs: DataFrame, wanted: DataFrame, combine: bool) -> DataFrame:
    """(part, key, place, before, context) of the wanted anchors of one document per text.

    With `combine`, a whole context that occurs again in the same slice of
    texts is told at once: its occurrences come as spans, with no part, their
    begin as place and their length as before, and one of them stands for all
    towards other tasks. So a passage that very many documents share makes one
    row per slice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            names = batch.schema.names
            out: list[tuple] = []
            first: dict[tuple[int, bytes], tuple[int, int] | None] = {}
            spans: list[tuple[int, int, int]] = []
            for key, text, found in zip(*(batch.column(names.index(c)).to_pylist() for c in ("key", "text", "places")), strict=True):
                data = (text or "").encode()
                for place in found:
                    begin = max(0, place - LEFT)
                    context = data[begin:place + LENGTH]
                    if combine and len(context) >= LENGTH:
                        known = (place - begin, context)
                        if known in first:
                            if (other := first[known]) is not None:
                                spans.append((*other, other[1] + len(context)))
                                first[known] = None
                            spans.append((key, begin, begin + len(context)))
                            continue
                        first[known] = key, begin
                    out.append((xxhash.xxh3_64_intdigest(data[place:place + ANCHOR]) >> 1, key, place, place - begin, context))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            if spans:
                out += [(None, int(k), int(a), int(b - a), None) for k, a, b in zip(
                    *merged(*(np.array(c, np.int64) for c in zip(*spans, strict=True))), strict=True)]
            if out:
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)],
            names=["part", "key", "place", "before", "context"])

    right = near(wanted, F.size("places") * 8 + 16).withColumnRenamed("key", "_key")
    chosen = docs.join(right, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("first")))
    return chosen.select("key", "text", "places").mapInArrow(cut, "part long, key long, place long, before long, context binary")


def split_large(found: DataFrame, most: int, joined: bool) -> tuple[DataFrame, DataFrame | None]:
    """Deals anchors with more than `most` contexts by a longer string; with `joined`, strings that are still as frequent come apart.

    A string of LENGTH bytes around an anchor reaches LEFT / 2 bytes beyond it
    on one side at least, so contexts that share one meet under the anchor
    with that much before it (side 2) or with that much after it (side 1).
    """
    # The contexts are cut again rather than stored: they come from the texts without an exchange.
    large = found.groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("part").alias("_large"))
    large = cut_lineage(large)
    if large.isEmpty():
        return found, None
    large = near(large, F.lit(8))
    half = LEFT // 2
    joined_on = F.col("part") == F.col("_large")
    after = F.when(F.octet_length("context") - F.col("before") >= ANCHOR + half, F.struct(
        F.xxhash64(F.lit(1), F.expr(f"substring(context, before + 1, {ANCHOR + half})")).alias("part"), F.lit(1).alias("side")))
    ahead = F.when(F.col("before") >= half, F.struct(
        F.xxhash64(F.lit(2), F.expr(f"substring(context, before + 1 - {half}, {ANCHOR + half})")).alias("part"), F.lit(2).alias("side")))
    strings = F.explode(F.array_compact(F.array(after, ahead))).alias("dealt")
    columns = ["key", "place", "before", "context"]
    on = found.join(large, joined_on).select(strings, *columns).select("dealt.part", "dealt.side", *columns)
    rest = found.join(large, joined_on, "left_anti")
    if not joined:
        return rest.unionByName(on.drop("side")), None
    hot = on.groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("part").alias("_hot"))
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return rest.unionByName(on.drop("side")), None
    hot = near(hot, F.lit(8))
    return (rest.unionByName(on.join(hot, F.col("part") == F.col("_hot"), "left_anti").drop("side")),
            on.join(hot, F.col("part") == F.col("_hot")).drop("_hot"))


def repeated_windows(hot: DataFrame, parts: int) -> DataFrame:
    """(key, group, begin, end) of the strings of LENGTH bytes around the anchors of `hot` (part, side, ...) that occur twice.

    For strings so frequent that no task can hold their contexts. All repeats
    of an occurrence hold its anchor, so the strings of LENGTH bytes in them
    that do so cover them whole. Such a string that occurs twice in a batch is
    told there, and one row stands for it towards other tasks, where the rows
    stream by in the order of their hashes. A string of side 1 has LEFT / 2
    bytes and more after the anchor, one of side 2 less.
    """
    shape = "part long, window long, key long, begin long, end long"
    names = ["part", "window", "key", "begin", "end"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(2000 * (LEFT + LENGTH))
        shift = np.arange(LEFT + 1)  # bytes after the anchor
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                some = batch.slice(first, 2000)
                part, side, key, place, before = (some.column(n).to_numpy() for n in range(5))
                rows = some.column(5).to_pylist()
                sizes = np.array([len(r) for r in rows])
                begins = np.cumsum(sizes) - sizes
                data = np.frombuffer(b"".join(rows), np.uint8)
                if len(data) < LENGTH:
                    continue
                hashes = rolling.hashes(data, LENGTH).view(np.int64)
                offset = before[:, None] - LEFT + shift
                usable = (offset >= 0) & (offset + LENGTH <= sizes[:, None]) & ((shift >= LEFT // 2) == (side == 1)[:, None])
                row, column = np.nonzero(usable)
                window = hashes[begins[row] + offset[row, column]]
                order = np.lexsort((window, part[row]))
                row, column, window = row[order], column[order], window[order]
                begin = place[row] - LEFT + shift[column]
                same = (window[1:] == window[:-1]) & (part[row[1:]] == part[row[:-1]])
                again = np.concatenate([[False], same])[:len(row)]
                met = again | np.concatenate([same, [False]])[:len(row)]
                spans = merged(key[row[met]], begin[met], begin[met] + LENGTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (
                    (part[row[~again]], spans[0]), (window[~again], spans[1]), (key[row[~again]], spans[0]),
                    (begin[~again], spans[1]), (np.zeros(int((~again).sum()), np.int64), spans[2]))], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, False  # the row before; whether it has met no other yet
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            spans = rows[4] > 0
            if spans.any():
                yield batch_of(rows[2, spans], rows[3, spans], rows[4, spans])
            rows = rows[:, ~spans]
            if not rows.shape[1]:
                continue
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            same = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last is not None:
                met[0] = waiting and met[0]
            waiting = True if len(same) == 0 else not same[-1]
            last = rows[:, -1]
            if met.any():
                yield batch_of(*merged(rows[2, met], rows[3, met], rows[3, met] + LENGTH))

    def batch_of(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        columns = (key, np.zeros(len(key), np.int64), begin, end)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "group", "begin", "end"])

    dealt = hot.select("part", F.col("side").cast("long"), "key", "place", "before", "context").mapInArrow(deal, shape)
    ordered = dealt.repartition(parts, "part", "window").sortWithinPartitions("part", "window", "key", "begin")
    return ordered.mapInArrow(meet, "key long, group long, begin long, end long")


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b, `most` at most."""
    differ = a != b
    first = differ.argmax(axis=1)
    return np.minimum(np.where(differ.any(axis=1), first, a.shape[1]), most)


def intervals(shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the intervals of a suffix array, inner ones first.

    `shared[n]` is the common prefix of the suffixes n and n + 1. One pass with
    a stack of open intervals; only prefixes of at least `least` are kept.
    """
    stack: list[list[int]] = []
    for n, length in enumerate([*shared.tolist(), 0]):
        begin = n
        while stack and stack[-1][0] > length:
            depth, begin = stack.pop()
            yield depth, begin, n
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append([length, begin])


def maximal_repeats(before: np.ndarray, rows: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(occurrences, bytes before the anchor of each, bytes from it) of each group of repeats of at least `length` bytes.

    A group lists all occurrences that extend as far as another one in it.
    """
    n = len(rows)
    right = np.zeros((n, LENGTH), np.uint8)
    left = np.zeros((n, LEFT), np.uint8)
    for k, (row, at) in enumerate(zip(rows, before.tolist(), strict=True)):
        data = np.frombuffer(row, np.uint8)
        right[k, :len(row) - at] = data[at:]
        left[k, :at] = data[:at][::-1]
    after = np.array([len(r) for r in rows]) - before
    order = np.argsort(right.view(f"S{LENGTH}").ravel(), kind="stable")
    shared = common(right[order[1:]], right[order[:-1]], np.minimum(after[order[1:]], after[order[:-1]]))
    # Rank of the left contexts, and what neighbours in that order have in common.
    by_left = np.argsort(left.view(f"S{LEFT}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    for depth, first, last in intervals(shared, ANCHOR):
        own = order[first:last + 1]
        own = own[np.argsort(rank[own])]
        beside = common(left[own[1:]], left[own[:-1]], np.minimum(before[own[1:]], before[own[:-1]]))
        # Left extensions that differ part the interval; a member reaches as far as its nearer neighbour.
        reach = np.maximum(np.concatenate([[0], beside]), np.concatenate([beside, [0]]))
        long = reach + depth >= length
        if long.any():
            yield own[long], reach[long], depth


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(s) for s in out]


def merged(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans (key, begin, end) with those of a key that overlap or touch made one."""
    if not len(key):
        return key, begin, end
    keys, number = np.unique(key, return_inverse=True)
    apart = int(end.max()) + 2  # lays the texts side by side on one line
    order = np.argsort(begin + number * apart, kind="stable")
    number = number[order]
    begin, end = begin[order] + number * apart, np.maximum.accumulate(end[order] + number * apart)
    first = np.concatenate([[True], begin[1:] > end[:-1]])
    number, last = number[first], np.concatenate([first[1:], [True]])
    return keys[number], begin[first] - number * apart, end[last] - number * apart


def whole_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of batches that come in the order of their first column, the part; no part is cut."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate([[last is not None and part[0] != last], part[1:] != part[:-1]]))
        last, at = part[-1], 0
        while (k := np.searchsorted(begins, at + rows - count)) < len(begins):
            held.append(batch.slice(at, begins[k] - at))
            yield pa.Table.from_batches(held)
            held, count, at = [], 0, int(begins[k])
        held.append(batch.slice(at))
        count += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def repeats(docs: DataFrame, *, joined: bool = False, per_part: int = 25_000, most: int = 20_000, scanned: int = 5_000) -> DataFrame:
    """(key, group, begin, end) of all occurrences of maximal repeats in the distinct texts of `docs` (doc_id, text, key).

    `group` numbers the repeats of one task. With `joined` a task's spans of a
    text are made one where they overlap. Tasks are dealt about `per_part`
    contexts of LEFT + LENGTH bytes, which come in the order of their parts,
    and hold some `scanned` of them, or one larger part, at a time; anchors
    with more than `most` are dealt on by longer strings, and with `joined` by
    all strings of LENGTH bytes where those are as frequent, so that no task
    holds such a part. Without `joined`, such a part is scanned whole.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0]
    places = repeated_anchors(docs, pieces(size, 64 << 20))
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("first")).withColumnRenamed("key", "_k")
    wanted = places.groupBy("key").agg(F.collect_list("place").alias("places"))
    wanted = cut_lineage(wanted.join(firsts, F.col("key") == F.col("_k")).select("key", "first", "places"))
    count = wanted.agg(F.sum(F.size("places"))).first()[0]
    everything = contexts(docs, wanted, joined)
    found = everything.where(F.col("part").isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = 0
        for held in whole_parts(batches, scanned):
            # an occurrence dealt by two strings may come twice and must not meet itself
            order = np.lexsort((held["place"].to_numpy(), held["key"].to_numpy()))
            pairs = np.stack([held[c].to_numpy()[order] for c in ("key", "place")])
            order = order[np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])]
            before, place, key = (held[c].to_numpy()[order] for c in ("before", "place", "key"))
            context = held["context"].to_pylist()
            found = maximal_repeats(before, [context[n] for n in order], LENGTH)
            if joined:
                # All spans of an occurrence hold its anchor, so together they reach as far as any does.
                left, right = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                for member, reach, depth in found:
                    left[member] = np.maximum(left[member], reach)
                    right[member] = np.maximum(right[member], depth)
                told = right > 0
                of, begin, end = merged(key[told], (place - left)[told], (place + right)[told])
                yield batch_of(of, np.zeros(len(of), np.int64), begin, end)
                continue
            out: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for member, reach, depth in found:
                out.append((key[member], np.full(len(member), group), place[member] - reach, place[member] + depth))
                group += 1
                waiting += len(member)
                if waiting > 100_000 or len(out) > 10_000:
                    yield batch_of(*(np.concatenate(c) for c in zip(*out, strict=True)))
                    out, waiting = [], 0
            if out:
                yield batch_of(*(np.concatenate(c) for c in zip(*out, strict=True)))

    def batch_of(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "group", "begin", "end"])

    dealt, hot = split_large(found, most, joined)
    dealt = dealt.repartition(pieces(count, per_part), "part")
    ordered = dealt.sortWithinPartitions("part").select("part", "key", "place", "before", "context")
    spans = ordered.mapInArrow(scan, "key long, group long, begin long, end long")
    if not joined:
        return spans
    if hot is not None:
        spans = spans.unionByName(repeated_windows(hot, pieces(count, per_part)))
    told = everything.where(F.col("part").isNull())
    return spans.unionByName(told.select("key", F.lit(0).cast("long").alias("group"), F.col("place").alias("begin"),
                                           (F.col("place") + F.col("before")).alias("end")))


def remove_repeats(docs: DataFrame, found: DataFrame, *, carry: list[str]) -> DataFrame:
    """Adds kept, kept_text, n_bytes, n_removed and n_spans to the columns `carry` of `docs` (which has text and key).

    `kept` are the bytes left; `kept_text` the same without characters that a
    removed span cut in two.
    """
    copies = docs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"begin": a, "end": b} for a, b in union([(s["begin"], s["end"]) for s in listed])]
                     for listed in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["key", "spans"])

    shape = "key long, spans array<struct<begin: long, end: long>>"
    spans = found.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")).mapInArrow(settle, shape)
    told = cut_lineage(spans.withColumnRenamed("key", "_k").join(copies, F.col("_k") == F.col("key"), "full").select(
        F.coalesce("_k", "key").alias("_key"), "spans", F.coalesce("n", F.lit(1)).alias("_copies")))
    told = near(told, F.coalesce(F.size("spans"), F.lit(0)) * 16 + 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            names = batch.schema.names
            kept, told = [], []
            for text, spans, copies in zip(*(batch.column(names.index(c)).to_pylist() for c in ("text", "spans", "_copies")), strict=True):
                data = (text or "").encode()
                gone = union([(s["begin"], s["end"]) for s in spans or []])
                if (copies or 1) > 1 and len(data) >= LENGTH:
                    gone = [(0, len(data))]
                at, parts = 0, []
                for begin, end in gone:
                    parts.append(data[at:begin])
                    at = end
                parts.append(data[at:])
                kept.append(b"".join(parts))
                told.append((len(data), len(data) - len(kept[-1]), len(gone)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in carry), pa.array(kept, pa.binary()),
                 pa.array([k.decode(errors="ignore") for k in kept], pa.string()),
                 *(pa.array([t[k] for t in told], pa.int64()) for k in range(3))],
                names=[*carry, "kept", "kept_text", "n_bytes", "n_removed", "n_spans"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "kept binary, kept_text string, n_bytes long, n_removed long, n_spans long"])
    joined = docs.join(told, F.col("key") == F.col("_key"), "left")
    return joined.select(*dict.fromkeys([*carry, "text"]), "spans", "_copies").mapInArrow(cut, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without their repeated passages; n_chars follows if there is one.

    A document of which no word is left goes.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    held = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"), row.alias("row"))
    left = remove_repeats(held, repeats(held.select("doc_id", "text", "key"), joined=True), carry=["text", "row"])
    left = left.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    told = {"text": changed, "n_chars": F.char_length(changed).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return left.select(*[told.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
