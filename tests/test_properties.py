"""Helpers and loops against brute force on random data, and laws that must hold."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import delivery, graphs, index, retrieval
from tidemark.operators.containment import contained, levels
from tidemark.operators.keyed import asof_last, salted_join, top_per_key
from tidemark.operators.incidents import dedupe_alerts, detect_incidents
from tidemark.plans import bindings as b
from tidemark.session import scratch_path
from tidemark.streaming import streams

SF = "/root/testdata/sf0.001"
START = dt.datetime(2026, 1, 1)


def skewed(rng, n):
    """A third of all rows fall on one key."""
    return ["hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rights = [(k, START + dt.timedelta(minutes=rng.randrange(6000)), i) for i, k in enumerate(skewed(rng, 120))]
    lefts = [(k, START + dt.timedelta(minutes=rng.randrange(6000)), i) for i, k in enumerate(skewed(rng, 200))]
    left = spark.createDataFrame(lefts, "k string, at timestamp, id int")
    right = spark.createDataFrame(rights, "k string, t timestamp, rid int")
    got = {r.id: r.hit.rid if r.hit else None for r in asof_last(left, right, ["k"], "at", "t", ["rid"], ["rid"], "hit", 3600).collect()}
    want = {}
    for k, when, i in lefts:
        before = [(t, rid) for rk, t, rid in rights if rk == k and t <= when]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_salted_join_equals_join(spark):
    rng = random.Random(3)
    large = spark.createDataFrame([(k, i) for i, k in enumerate(skewed(rng, 300))], "k string, id int")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = large.join(small, "k", how), salted_join(large, small, ["k"], ["id"], how)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_top_per_key(spark):
    rng = random.Random(4)
    data = [(k, rng.randrange(50), i) for i, k in enumerate(skewed(rng, 300))]
    df = spark.createDataFrame(data, "k string, v int, id int")
    got = sorted((r.k, r.id) for r in top_per_key(df, ["k"], [F.col("v").desc(), F.col("id").asc()], 4).collect())
    want = []
    for key in {k for k, _, _ in data}:
        best = sorted([(-v, i) for k, v, i in data if k == key])[:4]
        want += [(key, i) for _, i in best]
    assert got == sorted(want)


def random_tree(rng, file, counter):
    rows = []

    def grow(parent, depth):
        node = len(rows) + 1
        rows.append(None)
        pre = counter[0]
        counter[0] += 1
        for _ in range(rng.randrange(4) if depth < 6 else 0):
            grow(node, depth + 1)
        rows[node - 1] = ("r", file, node, parent, pre, counter[0], rng.choice("fgx"))
        counter[0] += 1

    grow(None, 0)
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_containment_equals_range_join(spark, seed):
    rng = random.Random(seed)
    nodes = [row for i in range(6) for row in random_tree(rng, f"f{i}", [0])]
    ast = spark.createDataFrame(nodes, "repository_id string, file_path string, node_id int, parent_id int, pre int, post int, type string")
    pairs = contained(ast, F.col("type") == "f", F.col("type").isin("f", "g"), {"o": F.col("node_id")}, {"i": F.col("node_id")})
    got = sorted((r.file_path, r.o, r.i) for r in pairs.collect())
    want = sorted((a[1], a[2], c[2]) for a in nodes if a[6] == "f" for c in nodes if c[1] == a[1] and c[6] in "fg" and a[4] <= c[4] <= a[5])
    assert got == want
    depth = {(r.file_path, r.node_id): r.f_level for r in levels(ast, {"f": F.col("type") == "f"}).collect()}
    assert depth == {(n[1], n[2]): sum(1 for a in nodes if a[1] == n[1] and a[6] == "f" and a[4] <= n[4] <= a[5]) for n in nodes}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_strong_groups_equal_mutual_reachability(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for _ in range(40)}
    pairs = {(a, c) for a, c in pairs if a != c}
    reach = {a: {a} for p in pairs for a in p}
    for _ in reach:
        for a, c in pairs:
            for seen in reach.values():
                if a in seen:
                    seen.add(c)
    want = {}
    for node, seen in reach.items():
        group = [m for m in seen if node in reach[m]]
        if len(group) > 1:
            want[node] = min(group)
    edges = spark.createDataFrame([("r", a, c) for a, c in pairs], "repository_id string, src string, dst string")
    groups = graphs.strong_groups(edges)
    assert {r.node: r.group for r in groups.collect()} == want
    for r in graphs.cycles(edges, groups).collect():
        assert r.chain[0] == r.chain[-1] == r.group
        assert all((x, y) in pairs for x, y in zip(r.chain, r.chain[1:]))
    found = {tuple(r.chain) for r in graphs.file_cycles(edges, groups).collect()}
    assert found == shortest_cycles(pairs)
    assert {n for chain in found for n in chain} == set(want)


def shortest_cycles(pairs):
    """Per file the first shortest way back to it by plain search, turned to its smallest file; one per set of files."""
    best = {}
    for start in {a for a, _ in pairs}:
        ways, seen = [(start,)], {start}
        while ways and not any((w[-1], start) in pairs for w in ways):
            ways = sorted((*w, c) for w in ways for a, c in pairs if a == w[-1] and c not in seen)
            seen |= {w[-1] for w in ways}
        for way in sorted(w for w in ways if (w[-1], start) in pairs)[:1]:
            at = way.index(min(way))
            turned = way[at:] + way[:at]
            best[frozenset(way)] = min(best.get(frozenset(way), turned), turned)
    return {(*way, way[0]) for way in best.values()}


def test_coupling_ends_sum_to_edges(spark):
    edges = b.graph_edges(spark, SF)
    files = edges.select("repository_id", F.explode(F.array("src", "dst")).alias("path")).distinct()
    total = graphs.coupling(edges, files).agg(F.sum("efferent"), F.sum("afferent")).first()
    assert total[0] == total[1] == edges.count()


def test_snapshot_against_itself_is_unchanged(spark):
    previous, _ = b.snapshots(spark, SF)
    assert {r.change for r in index.diff_snapshot(previous, previous).select("change").distinct().collect()} == {"same"}


def test_upsert_twice_equals_once(spark):
    previous, current = b.snapshots(spark, SF)
    keys = ["repository_id", "path"]
    once = delivery.upsert(previous, current, keys)
    twice = delivery.upsert(once, current, keys)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_search_equals_numpy_and_blocks_agree(spark):
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[7] = vectors[9]
    chunks = spark.createDataFrame([(i, f"r{i % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)],
                                   "id int, repository_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in (7, 50, 60)], "query_id int, embedding array<float>")
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    for chunk_rows, query_rows in ((10**6, 10**6), (70, 1)):
        got = {}
        for r in retrieval.search(chunks, queries, 5, chunk_rows=chunk_rows, query_rows=query_rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
        for q, found in got.items():
            scores = unit @ unit[q]
            want = sorted(range(400), key=lambda i: (-round(float(scores[i]), 12), i))[:5]
            assert [c for _, c in sorted(found)] == want


def test_split_covers_every_line_in_order(spark):
    rng = random.Random(11)
    text = "\n".join("x" * rng.randrange(400) for _ in range(200)) + "\n" + "y" * 9000 + "\nend"
    df = spark.createDataFrame([("k", text, 10)], "key string, content string, start_line int")
    pieces = sorted(index.split_oversized(df, 1000, 5).collect(), key=lambda r: r.start_line)
    lines = text.splitlines()
    assert pieces[0].start_line == 10 and pieces[-1].end_line == 10 + len(lines) - 1
    for piece, following in zip(pieces, [*pieces[1:], None]):
        assert piece.content == "\n".join(lines[piece.start_line - 10:piece.end_line - 9])
        if following:
            assert following.start_line == max(piece.end_line - 5 + 1, piece.start_line + 1)


def test_packed_context_is_a_prefix(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([("q", i, "x" * rng.randrange(3000)) for i in range(300)], "query_id string, rank int, content string")
    packed = sorted(r.rank for r in retrieval.pack_context(df).collect())
    assert packed == list(range(len(packed)))
    huge = spark.createDataFrame([("q", 0, "x" * 30000), ("q", 1, "y")], "query_id string, rank int, content string")
    assert [r.rank for r in retrieval.pack_context(huge).collect()] == [0]


def test_incident_stream_over_shuffled_files_equals_batch(spark, tmp_path):
    rng = random.Random(13)
    events = []
    for i in range(240):
        service = rng.choice(["api", "api", "api", "web", "gone"])
        events.append({"at": START + dt.timedelta(seconds=rng.randrange(200_000)), "kind": "close" if rng.random() < 0.2 else "alert", "service": service, "fp": f"{i:03d}"})
    # A last event far ahead moves the watermark past everything else.
    events.append({"at": START + dt.timedelta(days=400), "kind": "close", "service": "gone", "fp": "last"})
    ordered = events[:-1]
    rng.shuffle(ordered)
    ordered.append(events[-1])
    folder = tmp_path / "events"
    folder.mkdir()
    for n in range(0, len(ordered), 40):
        lines = [json.dumps({**e, "at": e["at"].isoformat()}) for e in ordered[n:n + 40]]
        (folder / f"part-{n:04d}.json").write_text("\n".join(lines))
    ddl = "at timestamp, kind string, service string, fp string"
    services = spark.createDataFrame([("o", "s1", "api"), ("o", "s2", "web")], "organization_id string, id string, name string")

    def inputs(raw):
        alerts = raw.filter("kind = 'alert'").select(
            F.lit("o").alias("organization_id"), F.col("fp").alias("fingerprint"), F.lit("firing").alias("status"),
            F.create_map(F.lit("service"), "service").alias("labels"), F.create_map(F.lit("x"), F.lit("y")).alias("annotations"),
            F.col("at").alias("starts_at"), F.col("at").alias("received_at"))
        closed = raw.filter("kind = 'close'").select(
            F.lit("o").alias("organization_id"), F.when(F.col("service") == "api", "s1").when(F.col("service") == "web", "s2").otherwise("s3").alias("service_id"),
            F.col("at").alias("closed_at"))
        return alerts, closed

    raw = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))
    alerts, closed = inputs(raw)
    rows = streams.detect_incidents_stream(alerts, closed, services, "10 days")
    out = scratch_path(spark, "stream-test")
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.service_id, r.fingerprint) for r in spark.read.schema(rows.schema).parquet(out).collect())
    alerts, closed = inputs(spark.read.schema(ddl).json(str(folder)))
    want = sorted((r.service_id, r.fingerprint) for r in detect_incidents(dedupe_alerts(alerts), services, closed).collect())
    assert got == want and len(want) > 10
