"""Text expressions: lines, hashes, token estimates, clipped slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks of text splitting and of byte splitting.
TEXT_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
BYTE_BREAKS = "\r\n|\n|\r"

# Fixed value: characters per estimated token.
CHARS_PER_TOKEN = 4


def _split_lines(content: Column, breaks: str) -> Column:
    body = F.regexp_replace(content, f"(?:{breaks})\\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, breaks))


def text_lines(content: Column) -> Column:
    """Lines of a text; a trailing break does not open an empty last line."""
    return _split_lines(content, TEXT_BREAKS)


def count_lines(content: Column) -> Column:
    """Lines of code: breaks on CR and LF only."""
    return F.size(_split_lines(content, BYTE_BREAKS))


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Entries `start` to `end` of a line array, 1-based and inclusive, joined by a line feed."""
    first = F.greatest(start, F.lit(1))
    wanted = F.greatest(end - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, first.cast("int"), wanted.cast("int")), "\n")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def token_estimate(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(content) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def strip(content: Column) -> Column:
    """Without white space at both ends, tabs and breaks included."""
    return F.regexp_replace(content, r"^\s+|\s+$", "")


def clip(content: Column, limit: int) -> Column:
    return F.substring(content, 1, limit)


def word_hits(content: Column, word: Column) -> Column:
    """How often `word` stands alone in `content`, letters of all scripts counting, without building a regex."""
    words = F.regexp_extract_all(content, F.lit(r"(?U)\w+"), F.lit(0))
    return F.size(F.filter(words, lambda token: token == word))


def non_empty(value: Column) -> Column:
    """Null for null and for empty text, the way `||` defaults read text."""
    return F.nullif(value, F.lit(""))


def json_text(raw: Column, opening: str, closing: str) -> Column:
    """The span from the first `opening` to the last `closing` bracket."""
    found = F.regexp_extract(raw, rf"(?s)\{opening}.*\{closing}", 0)
    return non_empty(found)
