"""Language-model scoring of whole corpora.

A bigram model with unigram smoothing is learnt from part of the documents and
scores all of them. P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu), with P(w) the
unigram estimate with half a count added. The logarithm of the numerator needs
counts of pairs that end in w only, that of the denominator the count of v
only; so when token pairs are dealt by their last word, each part holds all it
needs, builds its own trie, and returns its share of every document's score.

Words that occur so often that they would fill a part are dealt by pair; their
counts are few and go to all tasks. Very long texts make a slice of their own;
other columns are not read. A null or empty text has the end token
only; without training documents all words are unknown; repeated rows count as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, slices
from tidemark.llm.trie import Trie

SLICE = 4_000_000  # bytes of text whose pairs a task holds at once
# Words hold no white space, so these are not words.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(t)) for t in (b" end", b" begin"))


class Vocabulary(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def tokenised(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(hash of each word number, word numbers of all texts, tokens per text, held out, ids); 0 is the end, 1 the begin."""
    vocabulary = Vocabulary({b" end": 0, b" begin": 1})
    ids, texts = (batch.column(n).to_pylist() for n in (0, 1))
    parts, counts = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        words.append(b" end")
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
        counts.append(len(words))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary], np.uint64)
    return (hashes, np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(counts, np.int64),
            np.array([held_out(i) for i in ids], bool), ids)


def part_of(word: np.ndarray, context: np.ndarray, often: np.ndarray, parts: int) -> np.ndarray:
    """Where pairs are dealt: by their last word, frequent last words by the pair."""
    mixed = np.where(often, word ^ (context * np.uint64(0x9E3779B97F4A7C15)), word)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """Training counts by word hash, as (word, n); words of one slice of texts are counted before they leave the task.

    A row with a null word holds the number of all tokens, training or not, and
    one more the number of training documents (as a negative count).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = trained = 0
        for batch in slices(batches, "text", SLICE):
            hashes, words, counts, out, _ = tokenised(batch)
            n = np.bincount(words[np.repeat(~out, counts)], minlength=len(hashes))
            seen = n > 0
            tokens += int(counts.sum())
            trained += int((~out).sum())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[seen].view(np.int64)), pa.array(n[seen])], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([tokens, -trained - 1], pa.int64())],
                                         names=["word", "n"])

    return docs.mapInArrow(work, "word long, n long")


def score(docs: DataFrame, *, smoothing: float = 400.0, bits: int = 12, tokens_per_part: int = 2_000_000) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text).

    Two passes over the texts: word counts, then token pairs to parts of about
    `tokens_per_part`. The number of parts follows the corpus, and so do the
    counts and pairs that move; a task holds one part, or one slice of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one pass: the counts of each word, and under the null word the tokens and the training documents
    counted = count_words(docs).groupBy("word").agg(
        F.sum(F.when(F.col("n") >= 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("n") < 0, -F.col("n") - 1)).alias("trained"))
    limit = max(1, tokens_per_part // 8)
    known, no_word = F.col("word").isNotNull(), F.col("word").isNull()
    row = counted.agg(
        F.count("word").alias("V"), F.sum(F.when(known, F.col("n"))).alias("N"), F.sum(F.when(no_word, F.col("n"))).alias("tokens"),
        F.sum("trained").alias("trained"),
        F.collect_list(F.when(known & (F.col("n") > limit), F.struct("word", "n"))).alias("often")).first()
    n_train, trained = row["N"] or 0, row["trained"] or 0
    spread_over = n_train + 0.5 * (row["V"] + 1)
    parts = pieces(row["tokens"], tokens_per_part)
    # At most eight words per part pass the limit.
    often = sorted((np.uint64(o["word"] % (1 << 64)), o["n"]) for o in row["often"]) if parts > 1 else []
    often_words = np.array([o[0] for o in often], np.uint64)
    often_counts = np.array([o[1] for o in often], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for big in slices(batches, "text", SLICE):
            for begin in range(0, big.num_rows, 50_000):
                batch = big.slice(begin, 50_000)
                hashes, words, counts, out, ids = tokenised(batch)
                starts = np.cumsum(counts) - counts
                before = np.empty_like(words)
                before[1:] = words[:-1]
                before[starts] = 1
                document = np.repeat(np.arange(len(counts)), counts)
                # Word numbers in the order of their hashes make the parts sorted.
                rank = np.empty(len(hashes), np.int64)
                order = np.argsort(hashes)
                rank[order] = np.arange(len(hashes))
                ordered = hashes[order]
                w, v = rank[words], rank[before]
                wide = np.uint64(max(1, len(hashes) - 1).bit_length())
                deep = np.uint64(max(1, len(counts) - 1).bit_length())
                if int(2 * wide + deep) > 64:
                    raise ValueError("a slice of texts holds too many distinct words")
                key = (w.astype(np.uint64) << (wide + deep)) | (v.astype(np.uint64) << deep) | document.astype(np.uint64)
                key, times = np.unique(key, return_counts=True)
                w = (key >> (wide + deep)).astype(np.int64)
                v = ((key >> deep) & np.uint64((1 << int(wide)) - 1)).astype(np.int64)
                document = (key & np.uint64((1 << int(deep)) - 1)).astype(np.uint16)
                to = part_of(ordered[w], ordered[v], np.isin(ordered, often_words)[w], parts)
                by = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[by], np.arange(parts + 1))
                chunk = base + n
                n += 1
                rows = [(chunk % parts, chunk, None, None, None, None, None, out.tobytes(), ids, counts.tolist())]
                for part in range(parts):
                    own = by[edges[part]:edges[part + 1]]
                    if len(own):
                        used, of = np.unique(np.concatenate([w[own], v[own]]), return_inverse=True)
                        small = np.uint16 if len(used) <= 1 << 16 else np.uint32
                        rows.append((part, chunk, ordered[used].tobytes(), of[:len(own)].astype(small).tobytes(),
                                     of[len(own):].astype(small).tobytes(), document[own].tobytes(),
                                     np.minimum(times[own], 1 << 31).astype(np.uint32).tobytes(), out.tobytes(), None, None))
                    if len(rows) >= 64 or part == parts - 1:
                        if rows:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DEALT, strict=True)], names=DEALT_NAMES)
                        rows = []

    def answer(table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        metas = [r for r in held if r["ids"] is not None]
        held = [r for r in held if r["ids"] is None]
        out = [(r["chunk"], None, None, None, None, r["held_out"], r["ids"], r["counts"]) for r in metas]
        if held:
            # All words of the part get numbers in the order of their hashes.
            lists = [np.frombuffer(r["words"], np.uint64) for r in held]
            hashes = np.unique(np.concatenate(lists))
            w, v, documents, times, train = [], [], [], [], []
            for r, own in zip(held, lists, strict=True):
                small = np.uint16 if len(own) <= 1 << 16 else np.uint32
                number = np.searchsorted(hashes, own)
                w.append(number[np.frombuffer(r["last"], small)])
                v.append(number[np.frombuffer(r["before"], small)])
                documents.append(np.frombuffer(r["documents"], np.uint16))
                times.append(np.frombuffer(r["times"], np.uint32).astype(np.int64))
                train.append(~np.frombuffer(r["held_out"], bool)[documents[-1]])
            sizes = [len(x) for x in w]
            wide = np.uint64(32)
            pair, of = np.unique((np.concatenate(w).astype(np.uint64) << wide) | np.concatenate(v).astype(np.uint64),
                                 return_inverse=True)
            times, train = np.concatenate(times), np.concatenate(train)
            seen = np.bincount(of, weights=times * train, minlength=len(pair))
            last, before = (pair >> wide).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            c = np.bincount(last, weights=seen, minlength=len(hashes))
            at = np.searchsorted(often_words, hashes)
            frequent = (at < len(often_words)) & (often_words[np.minimum(at, len(often_words) - 1)] == hashes) if len(often_words) \
                else np.zeros(len(hashes), bool)
            c[frequent] = often_counts[at[frequent]]
            # The trie holds what training saw.
            words = np.flatnonzero(c > 0)
            number = np.full(len(hashes), -1, np.int64)
            number[words] = np.arange(len(words))
            trained_pairs = np.flatnonzero(seen > 0)
            unigram = (c[words] + 0.5) / spread_over
            trie = Trie.mapped(Trie.build(
                hashes[words], np.log10(unigram), np.log10(c[words] + smoothing), number[last[trained_pairs]],
                hashes[before[trained_pairs]],
                np.log10(seen[trained_pairs] + smoothing * unigram[number[last[trained_pairs]]]), bits))
            asked = trie.find_words(hashes)
            place = trie.find_pairs(asked[last], hashes[before])
            unseen = math.log10(0.5 / spread_over)
            lower = np.where(asked >= 0, trie.value("unigram", np.maximum(asked, 0)), unseen) if len(words) \
                else np.full(len(hashes), unseen)
            below = np.where(asked >= 0, trie.value("backoff", np.maximum(asked, 0)), math.log10(smoothing)) if len(words) \
                else np.full(len(hashes), math.log10(smoothing))
            below[hashes == END] = 0.0  # nothing follows the end
            top = np.where(place >= 0, trie.value("bigram", np.maximum(place, 0)), lower[last] + math.log10(smoothing)) \
                if len(trained_pairs) else lower[last] + math.log10(smoothing)
            model = (top - below[last])[of] * times
            plain = (np.log10(c + 0.5) - math.log10(spread_over))[last][of] * times
            known = (c > 0)[last][of] * times
            end = 0
            for r, size, document in zip(held, sizes, documents, strict=True):
                begin, end = end, end + size
                rows = np.unique(document)
                sums = [np.bincount(document, weights=x[begin:end], minlength=1)[rows] for x in (plain, model, known)]
                out.append((r["chunk"], rows.tobytes(), *(s.tobytes() for s in sums), None, None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ANSWERED, strict=True)], names=ANSWERED_NAMES)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r for r in rows if r["ids"] is not None)
        n = len(meta["ids"])
        sums = np.zeros((3, n))
        # a fixed order makes the sums of doubles the same in every run
        for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: (r["rows"], r["plain"])):
            at = np.frombuffer(r["rows"], np.uint16)
            for k, name in enumerate(("plain", "model", "known")):
                sums[k, at] += np.frombuffer(r[name], np.float64)
        begin = math.log10(trained + smoothing)
        return pa.table({
            "doc_id": pa.array(meta["ids"], pa.int64()), "held_out": pa.array(np.frombuffer(meta["held_out"], bool)),
            "n_tokens": pa.array(meta["counts"], pa.int64()), "n_known": pa.array(np.rint(sums[2]).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(sums[0]),
            "score": pa.array(sums[1] - begin)})

    dealt = docs.mapInArrow(deal, "part long, chunk long, words binary, last binary, before binary, documents binary, "
                                  "times binary, held_out binary, ids array<long>, counts array<long>")
    answered = dealt.groupBy("part").applyInArrow(
        answer, "chunk long, rows binary, plain binary, model binary, known binary, held_out binary, ids array<long>, "
                "counts array<long>")
    return answered.groupBy("chunk").applyInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


DEALT_NAMES = ["part", "chunk", "words", "last", "before", "documents", "times", "held_out", "ids", "counts"]
DEALT = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
ANSWERED_NAMES = ["chunk", "rows", "plain", "model", "known", "held_out", "ids", "counts"]
ANSWERED = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
