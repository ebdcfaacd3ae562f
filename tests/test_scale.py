"""What must not grow with the tables: landed bytes, broadcast sides, rows that joins repeat."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

import __spark_entry__ as entry
from tidemark.operators import retrieval
from tidemark.operators.keyed import large_join
from tidemark.plans import bindings
from tidemark.session import ensure, scratch_root
from tidemark.streaming import streams


def _bytes_under(folder):
    folder = folder.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)


@pytest.fixture
def documents(tmp_path):
    """Files of many lines, one of them twice, one without text."""
    text = "\n".join("x" * (40 + i % 37) for i in range(400))
    rows = [(i, text if i else None) for i in range(12)] + [(3, text)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    connection.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    return str(tmp_path), sum(len(text or "") for _, text in rows)


def test_trees_land_less_than_their_texts(spark, documents):
    """Nodes are some ten times the texts: they are made where they are read."""
    folder, size = documents
    ensure(spark)
    before = _bytes_under(scratch_root(spark))
    nodes = bindings.ast_nodes(spark, folder)
    landed = _bytes_under(scratch_root(spark)) - before
    assert 0 < landed < size / 2
    files = {r.file_path: r for r in nodes.groupBy("file_path").agg({"*": "count", "node_id": "max", "post": "max"}).collect()}
    assert len(files) == 11 and all(r["count(1)"] == r["max(node_id)"] + 1 and r["max(post)"] == 2 * r["count(1)"] - 1 for r in files.values())
    assert files["d3"]["max(node_id)"] == 2 * files["d6"]["max(node_id)"]


@pytest.mark.parametrize("name", [
    "gr10_unsafe_dependencies", "gr11_dependency_diff", "tm26_trivial_methods", "tm27_lsp_candidates", "tm28_isp_candidates",
    "tm30_strategy_families", "tm30_strategy_candidates"])
def test_large_sides_do_not_go_through_the_driver(spark, name):
    """The planner takes exploded rows for as few as the table they came from, so it must not choose."""
    plan = entry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_join_equals_join(spark, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)], "k string, id int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k0", 3), (None, 4)], "k string, v int")
    assert sorted(map(str, large_join(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_search_repeats_rows_per_share_not_per_block(spark, monkeypatch):
    """Small blocks are products inside a task: 300 vectors against 20 questions are one share of each."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 4))
    vectors[7] = vectors[250] = vectors[3]  # ties at the cut
    rows = [(i, "r", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "id long, repository_id string, embedding array<float>")
    asking = chunks.filter("id < 20").selectExpr("id AS query_id", "embedding")
    dealt = []
    monkeypatch.setattr(retrieval, "_share", lambda block, most, f=retrieval._share: dealt.append(f(block, most)) or dealt[-1])
    found = {tuple(r) for r in retrieval.search(chunks, asking, 2, chunk_rows=10, query_rows=4).select("query_id", "chunk_id", "rank").collect()}
    assert dealt == [32_760, 8_192]
    unit = np.float32(vectors) / np.linalg.norm(np.float32(vectors), axis=1, keepdims=True)
    scores = np.round(unit[:20] @ unit.T, 6)
    wanted = {(q, int(c), n + 1) for q in range(20) for n, c in enumerate(np.lexsort((np.arange(300), -scores[q]))[:2])}
    assert found == wanted


def test_both_sides_of_a_search_meet_in_any_number_of_partitions(spark):
    chunks = spark.range(40).selectExpr("id", "'r' AS repository_id", "array(double(cos(id / 9)), double(sin(id / 9))) AS embedding")
    asking = chunks.filter("id < 3").selectExpr("id AS query_id", "embedding")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = retrieval.search(chunks, asking, 1).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.query_id, r.chunk_id) for r in found) == [(0, 0), (1, 1), (2, 2)]


class _Store:
    """The state of one key, and how often it is called."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getMapState(self, name, *_):
        return _State(self, name)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _at(self, key=()):
        self.store.calls += 1
        return (self.name, key)

    def exists(self):
        return self._at() in self.store.values

    def containsKey(self, key):
        return self._at(key) in self.store.values

    def get(self):
        return self.store.values[self._at()]

    def update(self, value):
        self.store.values[self._at()] = value

    def getValue(self, key):
        return self.store.values[self._at(key)]

    def updateValue(self, key, value):
        self.store.values[self._at(key)] = value

    def removeKey(self, key):
        del self.store.values[self._at(key)]


def test_waiting_alerts_take_few_calls_to_the_state():
    """Rows come out of order over three hours in several batches; the watermark stops between them, also inside an hour."""
    rng = np.random.default_rng(3)
    us = rng.integers(0, 3 * 3_600_000_000, 6_000)
    rows = pd.DataFrame({
        "at_us": us, "closes": rng.random(6_000) < 0.4, "fingerprint": [f"f{i}" for i in range(6_000)],
        "title": [None if i % 5 == 0 else f"t{i}" for i in range(6_000)], "severity": "HIGH"})
    rows.loc[rows.closes, ["fingerprint", "title", "severity"]] = None
    store, opener, found = _Store(), streams.incident_opener(), []
    opener.init(store)
    steps = [(rows[:2_000], 1_000_000), (rows[2_000:5_000], 5_000_000), (rows[5_000:], 11_000_000)]
    late = rows[5_000:].at_us // 1000 <= 5_000_000  # what the stream would have turned away
    steps[2] = (rows[5_000:][~late], 11_000_000)
    early = rows[2_000:5_000].at_us // 1000 <= 1_000_000
    steps[1] = (rows[2_000:5_000][~early], 5_000_000)
    for batch, watermark in steps:
        times = TimerValues(0, watermark)
        list(opener.handleInputRows(("o", "s"), iter([batch[:700], batch[700:]]), times))
        for at in sorted(t for t in store.timers if t <= watermark):
            for part in opener.handleExpiredTimer(("o", "s"), times, ExpiredTimerInfo(at)):
                found += list(part.itertuples(index=False, name=None))
            store.timers.discard(at)
        assert not [t for t in store.timers if t <= watermark]
    taken = pd.concat([b for b, _ in steps]).assign(kind=lambda d: (~d.closes).astype(int)).sort_values(["at_us", "kind", "fingerprint"])
    wanted, is_open = [], False
    for r in taken.itertuples():
        if r.closes:
            is_open = False
        elif not is_open:
            is_open = True
            wanted.append(("o", "s", r.fingerprint, r.at_us, None if pd.isna(r.title) else r.title, r.severity))
    assert [tuple(None if v is None or v != v else v for v in f) for f in found] == wanted
    assert store.calls < 100
