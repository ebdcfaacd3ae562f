"""Cost-balanced packing of token sequences.

A document's ids are cut into pieces of at most a sequence's length. What is
shorter is placed longest first, each piece on the sequence with the lowest
estimated cost (linear plus quadratic in the piece's length) that has token
capacity left; a piece that does not fit whole is cut.

A null or empty text has the closing id only. Repeated rows are packed as
often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemark.llm.common import slices

CAPACITY = 1024
# Letters on whose classes Unicode versions may differ.
UNUSUAL = re.compile(r"[^\x00-\u024f]")
# tiktoken's pattern engine runs out of stack on a run of some 10**6 blanks; 2 * 10**5 are fine.
BLANKS = 50_000
RUN = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of byte-level vocabularies


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Ids:
    """Token ids of texts as little-endian 16-bit bytes.

    The vocabulary file is a byte-level one of the tokenizers library. Its
    ids are in merge order, so tiktoken gives the same ids from the same file,
    five times as fast; a text with unusual letters or a very long run of
    blanks, or with an added token written out, goes to tokenizers itself.
    """

    def __init__(self, vocabulary: str):
        self.tool = Tokenizer.from_str(vocabulary)
        letters = byte_of_letter()
        special = self.added = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): n for token, n in json.loads(vocabulary)["model"]["vocab"].items()
                 if token not in special}
        self.fast = tiktoken.Encoding("pack", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        unusual = not text.isascii() and UNUSUAL.search(text) or len(text) > BLANKS and RUN.search(text)
        if not unusual and not any(token in text for token in self.added):
            return np.array(self.fast.encode_ordinary(text), "<u2").tobytes()
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each piece its parts as (sequence, offset in it, start in piece, length).

    Longest first, always onto the cheapest sequence with capacity left; as
    many sequences as the tokens need, so less than one sequence is padding.
    """
    count = -(-sum(lengths) // capacity)
    open_ = [(0.0, n, 0) for n in range(count)]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for piece in sorted(range(len(lengths)), key=lambda n: (-lengths[n], n)):
        start = 0
        while start < lengths[piece]:
            spent, sequence, filled = heapq.heappop(open_)
            part = min(lengths[piece] - start, capacity - filled)
            out[piece].append((sequence, filled, start, part))
            start += part
            if filled + part < capacity:
                heapq.heappush(open_, (spent + cost(part, linear, quadratic), sequence, filled + part))
    return out


def pack(docs: DataFrame, vocabulary_path: str, *, capacity: int = CAPACITY, closing: int = 0, linear: float = 1.0,
         quadratic: float = 1.0 / 1024, group_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text) in sequences.

    Every task packs its own rows, `group_tokens` tokens at a time: nothing is
    shuffled, memory is bounded by the group, and a lost task is simply run
    again. The padding of a group is less than one sequence. Sequence ids hold the task's
    partition and a running number. The vocabulary has fewer than 65,536 ids
    and is read once, on the driver.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary)
        end = np.array([closing], "<u2").tobytes()
        base, used = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        short: list[tuple] = []  # (doc_id, start, bytes, tokens of the document)
        held = 0

        def emit(doc_id, start, part: bytes, total, sequence, offset) -> None:
            wide = np.frombuffer(part, "<u2").astype("<u4")
            rows.append((doc_id, start, len(wide), zlib.crc32(wide.tobytes()), total, base + sequence, offset))

        def drain() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        def settle() -> None:
            nonlocal used, held
            short.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
            placed = place([len(p[2]) // 2 for p in short], capacity, linear, quadratic)
            for (doc_id, start, part, total), where in zip(short, placed, strict=True):
                for sequence, offset, begin, length in where:
                    emit(doc_id, start + begin, part[2 * begin:2 * (begin + length)], total, used + sequence, offset)
            used += -(-held // capacity)
            short.clear()
            held = 0

        for batch in slices(batches, "text", 4_000_000):
            names = batch.schema.names
            keys, texts = (batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(keys, texts, strict=True):
                whole = ids.of(text or "") + end
                total = len(whole) // 2
                for start in range(0, total, capacity):
                    part = whole[2 * start:2 * (start + capacity)]
                    if len(part) == 2 * capacity:
                        emit(doc_id, start, part, total, used, 0)
                        used += 1
                    else:
                        short.append((doc_id, start, part, total))
                        held += len(part) // 2
                if held >= group_tokens:
                    settle()
            if rows:
                yield drain()
        settle()
        if rows:
            yield drain()

    return docs.select("doc_id", "text").mapInArrow(work, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
