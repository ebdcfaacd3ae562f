"""Ranked lexical search by presence masks.

For each item, the documents of a block are grouped by the mask of the item's
terms that they hold, put together from the terms' bitmaps. What a document
with a mask can score is bounded by its terms' largest frequencies and the
shortest document of the block, so masks are scored from the highest bound
down, and the rest is left alone as soon as a bound lies below the worst of the
item's best so far. Terms that occur in no item are only counted.

Two passes over the texts: counts, then scores. Each task keeps the best rows
of its items and nothing else; they meet by item, in two steps.

Null and empty texts hold no terms: such a document is found by no item, such
an item finds none. Very long texts are read in pieces and counted whole. Rows
of documents that occur again are documents of their own; items alike in id and
text are one. Equal scores go by doc_id, null first. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, slices

SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
TABLE = bytes(0x20 if b in SEPARATORS and not 0x41 <= b <= 0x5A else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
PIECE = 1 << 20  # bytes of a text whose terms are held at once
CELLS = 2_000_000  # documents times terms of a block
ITEM_BYTES = 4 << 20  # items of one search; more are searched block by block


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    data = (text or "").encode().translate(TABLE)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + PIECE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def counted(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(terms of each text, its occurrences of each word of the vocabulary)."""
    lengths = np.zeros(len(texts), np.int64)
    counts = np.zeros((len(texts), len(vocabulary)), np.int64)
    for n, text in enumerate(texts):
        for some in terms(text):
            lengths[n] += len(some)
            found = np.fromiter(map(vocabulary.get, some, repeat(len(vocabulary))), np.int64, len(some))
            counts[n] += np.bincount(found, minlength=len(vocabulary) + 1)[:-1]
    return lengths, counts


def blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, words))
    for batch in slices(batches, "text", 4_000_000):
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """(documents with a term, all terms, documents that hold each word), over all of `docs`; one row per task and word moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in blocks(batches, len(vocabulary)):
            lengths, counts = counted(batch.column(1).to_pylist(), vocabulary)
            total[0] += (lengths > 0).sum()
            total[1] += lengths.sum()
            total[2:] += (counts > 0).sum(axis=0)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(total[place])], names=["place", "n"])

    total = [0] * (len(vocabulary) + 2)
    for row in docs.mapInArrow(work, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[row["place"]] = row["n"]
    return total[0], total[1], total[2:]


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of a term's weight adds."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def by_mask(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(masks, documents by mask, begin, size) of the documents with a term; a row of `held` tells one's terms."""
    some = np.flatnonzero(held.any(axis=1))
    bits = np.packbits(held[some], axis=1)
    key = np.ascontiguousarray(bits).view(f"V{bits.shape[1]}").ravel()
    _, first, group, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = some[np.argsort(group, kind="stable")]
    return held[some[first]], order, np.cumsum(size) - size, size


def best_of_block(best: list[tuple], k: int, ids: list, m: np.ndarray, counts: np.ndarray, place: np.ndarray,
                  weight: np.ndarray) -> list[tuple]:
    """The k best (-score, has an id, id) of `best` and the documents of a block, for the item with the words `place`."""
    tf = counts[:, place]
    highest = tf.max(axis=0)
    bound = weight * shares(highest, m.min())

    def least() -> int:
        return -best[-1][0] if len(best) == k else 1

    if bound.sum() < least():
        return best
    masks, documents, begin, size = by_mask(tf > 0)
    most = masks @ bound
    order = np.argsort(-most, kind="stable")
    at = 0
    while at < len(order) and most[order[at]] >= least():
        taken, chosen = 0, []
        # masks down from the highest bound, as many as fill the list; a tie at its end is looked at
        while at < len(order) and taken < k and most[order[at]] >= least():
            group = order[at]
            chosen.append(documents[begin[group]:begin[group] + size[group]])
            taken += size[group]
            at += 1
        rows = np.concatenate(chosen)
        score = (weight * shares(tf[rows], m[rows, None])).sum(axis=1)
        good = score >= least()
        fresh = [(-int(s), ids[d] is not None, ids[d] or 0) for d, s in zip(rows[good].tolist(), score[good].tolist(), strict=True)]
        best = heapq.nsmallest(k, best + fresh)
    return best


def search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, doc_id, score) of the k best of each task for each of `items` (number, terms with their counts)."""
    words = sorted({word for _, own in items for word in own})
    vocabulary = {word: n for n, word in enumerate(words)}
    n_docs, n_terms, holding = statistics(docs, vocabulary)
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding]
    asked = [(number, np.array([vocabulary[w] for w in own], np.int64),
              np.array([weights[vocabulary[w]] * times for w, times in own.items()], np.int64)) for number, own in items if own]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {number: [] for number, _, _ in asked}
        for batch in blocks(batches, len(words)):
            lengths, counts = counted(batch.column(1).to_pylist(), vocabulary)
            if not n_terms:
                continue
            ids = batch.column(0).to_pylist()
            exact = lengths.astype(object) if 25 * int(lengths.max()) * n_docs >= 2 ** 63 else lengths
            m = (75 + (25 * exact * n_docs) // n_terms).astype(np.int64)
            for number, place, weight in asked:
                best[number] = best_of_block(best[number], k, ids, m, counts, place, weight)
        rows = [(number, doc_id if known else None, -score) for number, own in best.items() for score, known, doc_id in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "doc_id", "score"])

    return docs.mapInArrow(work, "item long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, *, k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best rows of `docs` (doc_id, text) for each row of `benchmark` (item_id, text).

    Items are taken in blocks of about `item_bytes`, which is what a task and
    the driver hold of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    parts = pieces(items.agg(F.sum(F.octet_length("text"))).first()[0], item_bytes)
    found = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        split = [(n, Counter(w for some in terms(row["text"]) for w in some)) for n, row in enumerate(own)]
        ids = docs.sparkSession.createDataFrame([(n, row["item_id"]) for n, row in enumerate(own)], "_item long, item_id long")
        hits = search_block(docs, split, k)
        # the best of some tasks first, then those of all
        some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        every = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
        hits = hits.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
        # the items of one block, bounded above
        told = hits.join(F.broadcast(ids), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")
        found = told if found is None else found.unionByName(told)
    return found
