"""Improbable-feature digests of documents.

A digest holds the byte windows of a text that are rarest among their
neighbours. Windows are ranked by how seldom their entropy occurs in the whole
corpus; those that win often enough are hashed into a chain of Bloom filters.
Two digests are compared by the bits their filters share, less what chance
would share.

Null and empty texts have an empty digest; two of those are alike (1.0), one
of them and any other text are not (0.0). A text without a winning window
(shorter than a window, or one byte repeated) has itself as its only feature.
Equal texts have equal digests, wherever they lie in a batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, slices

WINDOW = 32  # bytes of a feature, and how many neighbours compete
WINS = 8  # neighbourhoods that a feature must win
STEPS = 1000  # entropy levels
BITS = 2048  # of one filter
FEATURES = 160  # of one filter
HASHES = 5
UNRANKED = 0xFFFF


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array with a window of zeros at either end: (bytes, starts, ends)."""
    edge = bytes(WINDOW)
    data = np.frombuffer(b"".join([edge, *texts, edge]), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) + WINDOW
    return data, np.concatenate([[WINDOW], ends[:-1]]), ends


def entropies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each place; -1 where none lies within one text.

    The sum of c log c over the byte counts c of a window changes by what the
    byte that comes and the byte that goes find of their kind in it; both
    numbers come from comparing the data with itself at every lag.
    """
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    counts = np.arange(WINDOW + 1)
    weight = np.rint(counts * np.log2(np.maximum(counts, 1)) * 4096).astype(np.int64)
    step = np.diff(weight)
    change = step[before]
    change[WINDOW:] -= step[after[:-WINDOW]]
    spread = np.cumsum(change)[WINDOW - 1:]
    level = ((math.log2(WINDOW) * WINDOW * 4096 - spread) * (STEPS / (math.log2(WINDOW) * WINDOW * 4096))).astype(np.int32)
    out = np.full(len(data), -1, np.int32)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - WINDOW + 1, starts), -1)
    usable = np.cumsum(inside[:-1])[:len(level)] > 0
    out[:len(level)][usable] = np.clip(level, 0, STEPS)[usable]
    return out


def features(data: np.ndarray, levels: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the windows that win `WINS` neighbourhoods."""
    rank = np.where(levels >= 0, ranks[levels], UNRANKED).astype(np.uint64)
    best = (rank << np.uint64(40)) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while width < WINDOW:  # leftmost rarest of each neighbourhood
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = best[(best >> np.uint64(40)) < UNRANKED] & np.uint64((1 << 40) - 1)
    places = np.flatnonzero(np.bincount(best.astype(np.int64), minlength=1) >= WINS)
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].view("<u8") if len(places) else np.zeros((0, 4), np.uint64)
    hashed = np.zeros(len(places), np.uint64)
    for n in range(words.shape[1]):
        hashed = (hashed ^ words[:, n]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    return places, hashed * np.uint64(0xBF58476D1CE4E5B9)


def filters(hashes: np.ndarray) -> np.ndarray:
    """A chain of Bloom filters as rows of bits; each distinct feature goes in once, in text order."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = np.zeros((-(-len(hashes) // FEATURES), BITS), np.uint8)
    chain = np.arange(len(hashes)) // FEATURES
    for n in range(HASHES):
        out[chain, ((hashes >> np.uint64(8 + 11 * n)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return out


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filter chain of every text; bounded by the texts given."""
    data, starts, ends = joined(texts)
    places, hashes = features(data, entropies(data, starts, ends), ranks)
    first, last = np.searchsorted(places, starts), np.searchsorted(places, ends)
    out = []
    for text, a, b in zip(texts, first, last, strict=True):
        own = hashes[a:b]
        if text and a >= b:
            own = np.frombuffer(hashlib.sha1(text).digest()[:8], "<u8")
        out.append(filters(own))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bits shared beyond chance, 0 to 1: each filter of the shorter chain with its best partner, averaged."""
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    total = 0.0
    other = b.astype(np.float32)
    size_b = other.sum(axis=1)
    for row in a.astype(np.float32):  # one row at a time bounds the memory of very long texts
        shared, size = other @ row, row.sum()
        chance = size * size_b / BITS
        total += float(np.max((shared - chance) / np.maximum(np.minimum(size, size_b) - chance, 1e-9)))
    return min(1.0, max(0.0, total / len(a)))


def written(chain: np.ndarray) -> str:
    """A chain as text: hexadecimal, filter after filter."""
    return np.packbits(chain).tobytes().hex()


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of entropy levels, rarest first, from all windows of all texts.

    Tasks send a histogram of fixed size; levels of all-equal bytes are not ranked.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STEPS + 1, np.int64)
        for batch in slices(batches, "text", 1_000_000):
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            levels = entropies(*joined(texts))
            seen += np.bincount(levels[levels >= 0], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], names=["level", "n"])

    rows = docs.select("text").mapInArrow(work, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(STEPS + 1, np.int64)
    for row in rows:
        seen[row["level"]] = row["n"]
    ranks = np.empty(STEPS + 1, np.uint16)
    ranks[np.lexsort((np.arange(STEPS + 1), seen))] = np.arange(STEPS + 1)
    ranks[0] = UNRANKED
    return ranks


def beside_next(docs: DataFrame, rows_per_part: int = 8192, most_parts: int = 10_000) -> DataFrame:
    """(doc_id, text, _part, _tail) in id order, each part followed by the next part's first row.

    Rows are dealt by id ranges; the first row of a part is also sent to the
    part before it (the very first to the last) with _tail set. One row per
    part goes through the driver, `most_parts` at most.
    """
    ids = docs.select("doc_id")
    parts = min(most_parts, pieces(ids.count(), rows_per_part))
    cuts = np.array([], np.int64)
    if parts > 1:
        shares = [n / parts for n in range(1, parts)]
        found = ids.select(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.fillna(np.iinfo(np.int64).min).astype("int64")
        return pd.Series(np.searchsorted(cuts, known.to_numpy(), side="right").astype("int32"))

    # Small ranges of ids are found by comparison, without Python.
    part = part_of("doc_id") if len(cuts) > 64 else sum(
        (F.when(F.col("doc_id") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    heads = sorted((r["part"], r["none"], r["first"] or 0) for r in ids.groupBy(part.alias("part")).agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")).collect())
    firsts = [(None if none else first, heads[n - 1][0]) for n, (_, none, first) in enumerate(heads)]
    marks = docs.sparkSession.createDataFrame(firsts, "_first long, _before int")
    rows = docs.select("doc_id", "text", part.alias("_own")).join(
        F.broadcast(marks), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_own").alias("_part"), F.lit(False).alias("_tail"))
    tail = F.struct(F.col("_before").alias("_part"), F.lit(True).alias("_tail"))
    sent = rows.select("doc_id", "text", F.inline(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, tail))))
    return sent.repartition(max(1, len(heads)), "_part").sortWithinPartitions("_part", "_tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """`text` with its last half, rounded down, replaced by as much of `following`'s beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Digests of every text and its edited form, and their likeness.

    Rows stream through in id order; a task holds one slice of texts and the
    one row before it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, "text", 1_000_000):
            rows = held + list(zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True))
            held = rows[-1:] if not rows[-1][3] else []
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
            if not pairs:
                continue
            texts = [(r[1] or "") for r, _ in pairs]
            changed = [edited(t, nxt[1] or "") for t, (_, nxt) in zip(texts, pairs, strict=True)]
            # consecutive rows share their digests: the follower of a pair opens the next pair
            needed = [t.encode() for t in texts] + [(pairs[-1][1][1] or "").encode()]
            extra = [n for n in range(len(pairs) - 1) if pairs[n][1] is not pairs[n + 1][0]]
            needed += [(pairs[n][1][1] or "").encode() for n in extra]
            found = digests(needed, ranks)
            follower = {n: found[len(texts) + 1 + k] for k, n in enumerate(extra)}
            others = digests([t.encode() for t in changed], ranks)
            out = []
            for n, (row, _) in enumerate(pairs):
                nxt = follower.get(n, found[n + 1])
                out.append((row[0], len(texts[n]), hashlib.sha256(changed[n].encode()).hexdigest(), written(found[n]),
                            written(others[n]), likeness(found[n], others[n]), likeness(found[n], nxt)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return beside_next(docs).mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
