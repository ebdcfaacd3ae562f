"""Elias-Fano n-gram trie: compact, memory-mapped, searched by successor.

Level one holds the known words, level two the words seen before each of them.
Children of a word are a range of level two; the begins of the ranges are a
monotone sequence, and so are the children once every range is shifted by the
last value of the range before it (the context-relative form). All monotone
sequences are Elias-Fano coded; probabilities are codes of 16 bits at most into
a table of bin means.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

BLOCK = 4096  # values between two entry points of a sequence


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers.

    The low bits are packed side by side, the high bits stand in unary. Every
    BLOCK-th value has its place in the unary part and its value kept, so any
    block decodes alone.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.count, self.width = (int(n) for n in parts["head"])
        self.low, self.high, self.entry, self.first = (parts[n] for n in ("low", "high", "entry", "first"))

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) + 8) // 8 * 8 if n else 8, np.uint8)
        bits[high] = 1
        low = np.zeros(0, np.uint8)
        if width and n:
            shift = np.arange(width, dtype=np.uint64)
            each = 1 << 18  # values packed at a time
            low = np.concatenate([
                np.packbits(((values[a:a + each, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
                for a in range(0, n, each)])
        return {"head": np.array([n, width], np.int64), "low": low, "high": np.packbits(bits, bitorder="little"),
                "entry": high[::BLOCK].copy(), "first": values[::BLOCK].copy()}

    def block(self, n: int) -> np.ndarray:
        """Values n*BLOCK up to the next entry point."""
        begin, size = n * BLOCK, min(BLOCK, self.count - n * BLOCK)
        at = int(self.entry[n])
        until = int(self.entry[n + 1]) if n + 1 < len(self.entry) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8:-(-until // 8)], bitorder="little")
        ones = np.flatnonzero(bits[at % 8:at % 8 + until - at])[:size]
        out = (ones + at - begin - np.arange(size)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            first = begin * self.width  # a multiple of 8, as BLOCK is
            packed = self.low[first // 8:-(-(first + size * self.width) // 8)]
            low = np.unpackbits(packed, bitorder="little")[:size * self.width].reshape(size, self.width)
            out |= np.packbits(np.pad(low, ((0, 0), (0, 64 - self.width))), axis=1, bitorder="little").view("<u8").ravel()
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        """Values at ascending places."""
        out = np.zeros(len(at), np.uint64)
        of = at // BLOCK
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(starts, np.append(starts, len(at))[1:], strict=True):
            out[a:b] = self.block(int(of[a]))[at[a:b] - of[a] * BLOCK]
        return out

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending targets the place of the first value not less, and that value (count and 0 past the end)."""
        where = np.full(len(targets), self.count, np.int64)
        value = np.zeros(len(targets), np.uint64)
        # The block before the first entry that is not less holds the answer, or that entry is it.
        of = np.searchsorted(self.first, targets, side="left") - 1
        starts = np.flatnonzero(np.diff(of, prepend=-2))
        for a, b in zip(starts, np.append(starts, len(targets))[1:], strict=True):
            n = int(of[a])
            if n >= 0:
                values = self.block(n)
                at = np.searchsorted(values, targets[a:b])
                inside = at < len(values)
                where[a:b][inside] = at[inside] + n * BLOCK
                value[a:b][inside] = values[at[inside]]
            else:
                inside = np.zeros(b - a, bool)
            if n + 1 < len(self.first):
                where[a:b][~inside] = (n + 1) * BLOCK
                value[a:b][~inside] = self.first[n + 1]
        return where, value


def quantise(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and bin means: bins of equal population, exact while the distinct values are few."""
    distinct, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    if len(distinct) <= 1 << bits:
        return inverse.astype(np.uint16), distinct
    bins = np.minimum((np.cumsum(n) - n) * (1 << bits) // len(values), (1 << bits) - 1)
    _, bins = np.unique(bins, return_inverse=True)
    total = np.bincount(bins, weights=distinct * n)
    return bins[inverse].astype(np.uint16), total / np.bincount(bins, weights=n)


class Trie:
    """A two-level trie over sorted 64-bit word hashes, in one memory-mapped file."""

    SEQUENCES = ("words", "contexts", "pointers", "children")

    def __init__(self, parts: dict[str, np.ndarray]):
        for name in self.SEQUENCES:
            setattr(self, name, EliasFano({k.partition(".")[2]: v for k, v in parts.items() if k.startswith(f"{name}.")}))
        self.codes = {n: (parts[f"{n}.codes"], parts[f"{n}.table"]) for n in ("unigram", "backoff", "bigram")}

    @staticmethod
    def build(words: np.ndarray, unigram: np.ndarray, backoff: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray,
              bigram: np.ndarray, bits: int) -> dict[str, np.ndarray]:
        """Parts of a trie from sorted word hashes and pairs sorted by (word number, context hash)."""
        contexts, child = np.unique(pair_context, return_inverse=True)
        begin = np.searchsorted(pair_word, np.arange(len(words) + 1))
        # Within a range children count from 1; the shift is what the range before ends on.
        shifted = child.astype(np.uint64) + np.uint64(1)
        if len(child):
            last = np.where(begin[1:] > begin[:-1], shifted[np.maximum(begin[1:] - 1, 0)], np.uint64(0))
            shifted += np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)[:-1]])[pair_word]
        out = {}
        for name, values in zip(Trie.SEQUENCES, (words, contexts, begin, shifted), strict=True):
            out |= {f"{name}.{k}": v for k, v in EliasFano.build(values).items()}
        for name, values in (("unigram", unigram), ("backoff", backoff), ("bigram", bigram)):
            out[f"{name}.codes"], out[f"{name}.table"] = quantise(values, bits)
        return out

    @classmethod
    def mapped(cls, parts: dict[str, np.ndarray]) -> Trie:
        """Writes the parts to a file without a name and maps it; it goes with the process."""
        with tempfile.TemporaryFile() as file:
            places = {}
            for name, part in parts.items():
                part = np.ascontiguousarray(part)
                file.write(bytes(-file.tell() % 8))
                places[name] = (part.dtype, len(part), file.tell())
                file.write(part.tobytes())
            file.write(b"\0")
            file.flush()
            held = mmap.mmap(file.fileno(), os.fstat(file.fileno()).st_size, access=mmap.ACCESS_READ)
        return cls({n: np.frombuffer(held, dtype, count, at) for n, (dtype, count, at) in places.items()})

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        codes, table = self.codes[name]
        return table[codes[at]]

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending word hashes; -1 where unknown."""
        where, value = self.words.successor(hashes)
        return np.where((where < self.words.count) & (value == hashes), where, -1)

    def find_pairs(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Places in level two of (word number, context hash), ascending by word and hash; -1 where unseen."""
        out = np.full(len(word), -1, np.int64)
        hashes, inverse = np.unique(context, return_inverse=True)
        where, value = self.contexts.successor(hashes)
        child = np.where((where < self.contexts.count) & (value == hashes), where, -1)[inverse]
        known = np.flatnonzero((word >= 0) & (child >= 0))
        if not len(known):
            return out
        distinct, of = np.unique(word[known], return_inverse=True)
        begin = self.pointers.take(distinct).astype(np.int64)
        end = self.pointers.take(distinct + 1).astype(np.int64)
        shift = np.where(begin > 0, self.children.take(np.maximum(begin - 1, 0)), np.uint64(0))
        target = shift[of] + child[known].astype(np.uint64) + np.uint64(1)
        where, value = self.children.successor(target)
        hit = (where < end[of]) & (value == target)
        out[known[hit]] = where[hit]
        return out
