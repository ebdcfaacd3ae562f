"""Language identification by compression with raw-content dictionaries.

Per language a dictionary of plain text is taken from labelled documents; a
text belongs to the language whose dictionary makes it smallest. Narrow
margins are rejected.

A null text, an empty text and a text without any letter get `und`, score 0
and are rejected; a table without usable labels gives `und` everywhere.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters, everything else as single spaces."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if words and not words.replace(" ", "").isalpha():
        # Numbers that are no digits, such as fractions, count as word characters but are no letters.
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return words


def learn(docs: DataFrame, wanted: Column, *, per_language: int = 128, chars: int = 2000,
          dictionary_bytes: int = 131_072) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent language first.

    The bound: `per_language` labelled documents per language (the first in
    hash order of each hash slice, so repeated texts count once and no task
    holds a language), `chars` characters of each, `dictionary_bytes` in all.
    The driver holds that much per language and no more; languages are few.
    """
    labelled = docs.where(wanted & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    placed = labelled.select("lang", F.substring("text", 1, chars).alias("text"), F.xxhash64("text").alias("place"))
    sample = placed.groupBy("lang", F.pmod("place", F.lit(per_language)).alias("slice")).agg(
        F.min_by("text", F.struct("place", "text")).alias("text"), F.count("*").alias("n"))
    texts, seen = defaultdict(list), defaultdict(int)
    for row in sample.orderBy("lang", "slice").collect():
        texts[row["lang"]].append(letters(row["text"]).encode())
        seen[row["lang"]] += row["n"]
    return {lang: b"\n".join(texts[lang])[:dictionary_bytes] for lang in sorted(seen, key=lambda x: (-seen[x], x))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, level: int = 6, margin: float = 0.01,
             carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score, rejected to the columns `carry` of `docs`.

    Every whole text is compressed once per language. `margin` is the least
    advantage over the second best language, as a share of its size and a byte
    at least, below which the answer is rejected. Equal sizes are told as the
    more frequent language, and rejected.
    Memory stays at one batch and one dictionary per language.
    """
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for lang, plain in dictionaries.items():
            shared = zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            tools.append((lang, zstandard.ZstdCompressor(
                dict_data=shared, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)))

        def decide(text: str | None) -> tuple[str, float, bool]:
            plain = letters(text).encode()
            if not plain or not tools:
                return UNDETERMINED, 0.0, True
            sizes = sorted((len(tool.compress(plain)), n) for n, (_, tool) in enumerate(tools))
            best = sizes[0][0]
            if len(sizes) == 1:
                return tools[sizes[0][1]][0], 1.0, False
            # Two to the bits saved is how much likelier one language is; tempered, as bits overstate it.
            score = 1.0 / sum(math.exp(min(0.0, -(size - best) * 0.5)) for size, _ in sizes)
            return tools[sizes[0][1]][0], score, (sizes[1][0] - best) < max(1, margin * sizes[1][0])

        for batch in slices(batches, "text"):
            names = batch.schema.names
            told = [decide(t) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(c)) for c in carry]
                + [pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()),
                   pa.array([t[2] for t in told], pa.bool_())],
                names=[*carry, "lang_pred", "score", "rejected"])

    types = dict(zip(docs.columns, (f.dataType.simpleString() for f in docs.schema.fields), strict=True))
    schema = ", ".join([f"`{c}` {types[c]}" for c in carry] + ["lang_pred string", "score double", "rejected boolean"])
    return docs.mapInArrow(work, schema)


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose language is told with a sufficient margin."""
    dictionaries = learn(docs, F.lit(True))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    told = identify(docs.select("text", row.alias("row")), dictionaries, carry=["text", "row"]).where(~F.col("rejected"))
    return told.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
