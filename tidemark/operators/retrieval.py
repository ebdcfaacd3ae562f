"""Vector search over chunk embeddings, context packing, and conversation records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keyed import salted_join, top_per_key
from tidemark.schemas import require_columns

# Search and context limits, history length, evidence lengths.
SEARCH_LIMIT, DOC_SEARCH_LIMIT = 10, 5
MAX_CONTEXT_CHARS, HEADER_CHARS = 24_000, 200
HISTORY_MESSAGES = 15
CHAT_EVIDENCE_CHARS, TASK_EVIDENCE_CHARS = 1000, 1500
DOC_KIND = "DOCUMENTATION"

# One task's share of a search: rows of either side (a side of 8192 vectors of 768 doubles is 50 MB).
CHUNK_ROWS, QUERY_ROWS = 32_768, 8_192


# --- search ---------------------------------------------------------------------------

def search(
    chunks: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, repository_ids: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None, chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Exact cosine top-k of `chunks` for each query, filters first.

    `queries` has query_id and embedding. Both sides are dealt by hash into
    shares of whole blocks; each pair of shares meets in one task, which scores
    it block by block, a matrix product each, and passes on only what can be
    among the first k. Neither side goes through the driver. Every row is
    repeated once per share of the other side, so a share holds as many blocks
    as `CHUNK_ROWS` and `QUERY_ROWS` take, which with `chunk_rows` and
    `query_rows` set a task's memory.
    """
    require_columns(chunks, "id", "repository_id", "embedding")
    rows = chunks.filter(F.col("embedding").isNotNull())
    if repository_ids is not None:
        rows = rows.filter(F.col("repository_id").isin(*repository_ids))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    chunk_blocks = max(1, -(-rows.count() // _share(chunk_rows, CHUNK_ROWS)))
    query_blocks = max(1, -(-queries.count() // _share(query_rows, QUERY_ROWS)))
    # Both sides hash their keys by type as well: an int and a long of the same value go to different tasks.
    held = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(chunk_blocks)).cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"),
        F.col("id").alias("chunk_id"), "embedding")
    asking = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunk_blocks - 1))).alias("_c"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("_q"),
        "query_id", "embedding")
    types = {name: df.schema[name].dataType.simpleString() for df, name in ((held, "chunk_id"), (asking, "query_id"))}
    scored = held.groupBy("_c", "_q").cogroup(asking.groupBy("_c", "_q")).applyInArrow(
        _scorer(k, chunk_rows, query_rows), f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double")
    return top_per_key(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k, rank="rank")


def _share(block: int, most: int) -> int:
    """Rows of as many whole blocks as `most` rows take, of one at least."""
    return block * max(1, most // block)


def _scorer(k: int, chunk_rows: int, query_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def unit(table: pa.Table) -> np.ndarray:
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(table.num_rows, -1)
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(lengths == 0, 1.0, lengths)

    def score(held: pa.Table, asking: pa.Table) -> pa.Table:
        chunk_at, query_at, scores = [], [], []
        if held.num_rows and asking.num_rows:
            vectors, questions = unit(held), unit(asking)
            step, width = min(query_rows, 512), min(chunk_rows, 8192)
            for begin in range(0, len(questions), step):
                asked = questions[begin:begin + step]
                best = np.full((len(asked), k), -np.inf)  # the first k scores so far
                hits = []
                for first in range(0, len(vectors), width):
                    products = asked @ vectors[first:first + width].T
                    best = np.partition(np.concatenate([best, products], axis=1), -k, axis=1)[:, -k:]
                    rows, columns = np.nonzero(products >= best[:, :1])
                    hits.append((rows, columns + first, products[rows, columns]))
                rows, columns, found = (np.concatenate(x) for x in zip(*hits))
                # Keeps ties with the k-th score, so the final cut by id stays exact.
                kept = found >= best[rows, 0]
                query_at.append(rows[kept] + begin)
                chunk_at.append(columns[kept])
                scores.append(found[kept])
        none = np.zeros(0, np.int64)
        return pa.table({
            "query_id": asking["query_id"].take(pa.array(np.concatenate([none, *query_at]))),
            "chunk_id": held["chunk_id"].take(pa.array(np.concatenate([none, *chunk_at]))),
            "score": np.concatenate([np.zeros(0), *scores])})

    return score


def search_organization(
    chunks: DataFrame, repositories: DataFrame, organization_id: str, queries: DataFrame, k: int = SEARCH_LIMIT,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Search over every repository of the organization."""
    mine = repositories.filter(F.col("organization_id") == organization_id).select(F.col("id").alias("repository_id"))
    return search(chunks.join(mine, "repository_id", "left_semi"), queries, k, kinds=kinds)


def search_docs(chunks: DataFrame, queries: DataFrame, k: int = DOC_SEARCH_LIMIT, kind: str = DOC_KIND) -> DataFrame:
    return search(chunks, queries, k, kinds=[kind])


def hydrate(hits: DataFrame, chunks: DataFrame, symbols: DataFrame, repositories: DataFrame) -> DataFrame:
    """Hits with content and names; hits whose chunk is gone drop out.

    Hits are few per query, so they are what is shuffled to the tables.
    """
    found = chunks.select(F.col("id").alias("chunk_id"), "repository_id", "file_path", "kind", "content", "symbol_id")
    names = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
    homes = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository_name"))
    joined = hits.join(found, "chunk_id").join(names, "symbol_id", "left")
    return salted_join(joined, homes, ["repository_id"], ["query_id", "chunk_id"]).select(
        "query_id", "rank", "chunk_id", "score", "repository_id", "repository_name", "file_path", "kind", "symbol_name", "content")


# --- context --------------------------------------------------------------------------

def pack_context(hits: DataFrame, key: str = "query_id", order: Sequence[Column] = (), budget: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """The best hits per key that fit the budget; the first is always kept.

    Each block costs its length and a fixed header, so no more than
    budget / header blocks can fit: rows past that are dropped before the
    running sum, which then works on a small, bounded group.
    """
    order = list(order) or [F.col("rank").asc()]
    possible = top_per_key(hits, [key], order, budget // HEADER_CHARS + 1, rank="_place")
    running = Window.partitionBy(key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cost = F.length("content") + HEADER_CHARS
    return possible.withColumn("chars_used", F.sum(cost).over(running)).filter(
        (F.col("_place") == 1) | (F.col("chars_used") <= budget)).withColumnRenamed("_place", "place")


def render_context(packed: DataFrame, key: str = "query_id") -> DataFrame:
    """One text per key of tagged blocks, best first; a packed key holds at most the budget."""
    block = F.concat(
        F.lit('<context file="'), "file_path", F.lit('" repository="'), "repository_name", F.lit('" kind="'), "kind",
        F.lit('">\n'), "content", F.lit("\n</context>"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"])
    return packed.groupBy(key).agg(F.array_join(blocks, "\n\n").alias("context"))


def evidence_lines(chunks: DataFrame, calls: DataFrame, limit: int = CHAT_EVIDENCE_CHARS) -> DataFrame:
    """Evidence per retrieved chunk, then per tool call, as (key, source, position, line)."""
    retrieved = chunks.select(
        "key", F.lit("chunk").alias("source"), "position",
        F.concat("file_path", F.lit(": "), F.substring("content", 1, limit)).alias("line"))
    called = calls.select(
        "key", F.lit("call").alias("source"), "position",
        F.concat("tool_name", F.lit("("), "arguments", F.lit(") -> "), F.substring("result", 1, limit)).alias("line"))
    return retrieved.unionByName(called)


# --- citations ------------------------------------------------------------------------

def extract_citations(results: DataFrame) -> DataFrame:
    """Citable items of each tool result (`result` as JSON): a list of them, one,
    or a `matches` list. An item counts when its filePath and repositoryId are texts."""
    kept = [c for c in results.columns if c != "result"]
    parsed = results.withColumn("_v", F.try_parse_json("result"))

    def shape(value: Column) -> Column:
        return F.schema_of_variant(value)

    value, matches = F.col("_v"), F.try_variant_get("_v", "$.matches", "variant")

    def citable(item: Column) -> Column:
        path, home = (F.try_variant_get(item, f"$.{name}", "variant") for name in ("filePath", "repositoryId"))
        return F.coalesce((shape(path) == "STRING") & (shape(home) == "STRING"), F.lit(False))

    listed = F.coalesce(F.startswith(shape(value), F.lit("ARRAY")), F.lit(False))
    nested = F.coalesce(F.startswith(shape(matches), F.lit("ARRAY")), F.lit(False))
    items = (
        F.when(listed, F.try_variant_get("_v", "$", "array<variant>"))
        .when(citable(value), F.array(value))
        .when(nested, F.try_variant_get("_v", "$.matches", "array<variant>")))
    rows = parsed.select(*kept, F.posexplode(items).alias("item_position", "_item"))
    chunk = F.try_variant_get("_item", "$.chunkId", "variant")
    return rows.filter(citable(F.col("_item"))).select(
        *kept, "item_position", F.when(shape(chunk) == "STRING", F.try_variant_get("_item", "$.chunkId", "string")).alias("chunk_id"),
        F.try_variant_get("_item", "$.filePath", "string").alias("file_path"),
        F.try_variant_get("_item", "$.repositoryId", "string").alias("repository_id"))


def dedupe_citations(citations: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One citation per message and file path; the last one wins."""
    return top_per_key(citations, ["message_id", "file_path"], list(order or [F.col("position").desc()]), 1)


# --- conversations --------------------------------------------------------------------

def recent_history(messages: DataFrame, n: int = HISTORY_MESSAGES, order: str = "turn") -> DataFrame:
    """The last `n` messages without the newest, users and assistants only, oldest first."""
    recent = top_per_key(messages, ["conversation_id"], [F.col(order).desc()], n, rank="_newest")
    return recent.filter((F.col("_newest") > 1) & F.upper("role").isin("USER", "ASSISTANT")).drop("_newest").orderBy(
        "conversation_id", order)


def conversation_detail(messages: DataFrame, invocations: DataFrame, citations: DataFrame) -> DataFrame:
    """Each message of a conversation with its tool calls and citations nested.

    One row per message, in `turn` order within its conversation: a
    conversation can grow without bound, a message's calls and citations
    cannot, since the rounds that make them are limited.
    """
    calls = invocations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "tool_name", "arguments", "result", "status", "duration_ms"))).alias("tool_invocations"))
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "repository_id"))).alias("citations"))
    return (
        messages.join(calls, "message_id", "left").join(cited, "message_id", "left")
        .select("conversation_id", "turn", "message_id", "role", "content", "tool_invocations", "citations"))


def list_conversations(conversations: DataFrame, organization_id: str | None = None, user_id: str | None = None) -> DataFrame:
    rows = conversations
    if organization_id is not None:
        rows = rows.filter(F.col("organization_id") == organization_id)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.orderBy(F.col("updated_at").desc(), F.col("id").asc())


def unindexed_questions(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions without a hit in a repository without a chunk."""
    unanswered = questions.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    indexed = chunks.select("repository_id").distinct()
    return unanswered.join(indexed, "repository_id", "left_anti")
