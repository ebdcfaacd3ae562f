"""The n-gram join, lexical search and centroid clustering against brute-force versions, on awkward cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.samples import document_rows, sentence, tables
from tidemark.llm import clusters, jaccard, lexical
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run(spark, prefix, sf_dir):
    return QUERIES[next(n for n in QUERIES if n.startswith(prefix))](spark, sf_dir).collect()


def long_copies(seed: int = 9) -> list[tuple]:
    """Near copies on both sides of the threshold, chains of them, boundary sizes and a null id."""
    rng = random.Random(seed)
    rows, base = [], sentence(rng, "en", 150).split()
    for n in range(30):
        words = list(base)
        for _ in range(n % 4):
            words[rng.randrange(len(words))] = f"own{rng.randrange(6)}"
        rows.append((1000 + n, " ".join(words)))
    chain = sentence(rng, "de", 200).split()
    for n in range(12):
        chain[n * 15 + 3] = f"step{n}"
        rows.append((1100 + n, " ".join(chain)))
    rows += [(1200 + n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 25)]
    rows += [(1300, "two WORDS"), (1301, "Two words"), (1302, "two words more"), (None, rows[0][1]), (None, "word")]
    return [(i, t, None, "s", 0, 1, 2, 0.5, "r", "m") for i, t in rows]


ROWS = document_rows() + long_copies()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("joins")), documents=ROWS, benchmark=ITEMS, embeddings=VECTORS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("none")), documents=[], benchmark=[], embeddings=[])


@pytest.mark.parametrize("prefix", ["op11_", "op12_", "op13_"])
def test_empty_tables(spark, empty, prefix):
    assert run(spark, prefix, empty) == []


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def joined(rows):
    """(doc_id, n_shingles, component_id, n_links) by comparing every two rows."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 90 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(lambda: math.inf)
    for n, row in enumerate(rows):
        if row[0] is not None:
            least[root(n)] = min(least[root(n)], row[0])
    return sorted(((r[0], len(sets[n]), None if r[0] is None else least[root(n)], links[n]) for n, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows_per_block", [2048, 5])
def test_join_equals_all_pairs(spark, small, monkeypatch, rows_per_block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_per_block)  # groups of many blocks too
    monkeypatch.setattr(jaccard, "OFTEN", 6)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in run(spark, "op11_", small)]
    assert sorted(found, key=str) == joined(ROWS)


def test_product_counts_overlaps():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(20)]
    plain = np.array([[len(np.intersect1d(x, y)) for y in rows] for x in rows])
    held = np.array([len(r) for r in rows])
    whole = jaccard.overlaps(rows, 0)
    assert (whole - np.diag(np.diag(whole)) == plain - np.diag(held)).all()
    assert (jaccard.overlaps(rows, 7) == plain[:7, 7:]).all()


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[:rng.integers(0, len(x) + 1)], y[:rng.integers(0, 20)]]))
        bits = [np.frombuffer(jaccard.sketch(s), np.uint64) for s in (x, y)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(x, y))


ITEMS = [(n, t, 1, 0.5, 3, 4) for n, t in [
    (0, "the of the shing"), (1, "Der licht, der-KEIT!"), (2, None), (3, ""), (4, "### !"), (5, "nowhere9 absent"),
    (6, "École ünï 中文 it's"), (7, " ".join(["the of and shing thion nder erly over this whan ther hand oning which"] * 3)),
    (None, "word"), (8, "word"), (8, "the word"), (9, "own1 step3 w5 changed4"), (9, "own1 step3 w5 changed4")]]


def ranked(rows, items, k=20):
    texts = [(r[0], TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    n_docs, n_terms = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    holding = Counter(w for _, t in texts for w in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in texts]
    out = []
    for item_id, text in {(i[0], i[1] or "") for i in items}:
        hits = []
        for doc_id, own, held in counts:
            m = 75 + (25 * own * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1))) * ((1_000_000_000 * held[w]) // (1000 * held[w] + 12 * m))
                        for w in TERM.findall(text.translate(LOWER)) if held[w])
            if score > 0:
                hits.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, hit[3], -hit[0]) for rank, hit in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [2_000_000, 300])
def test_search_equals_scoring_everything(spark, small, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in run(spark, "op12_", small)]
    assert sorted(found, key=str) == ranked(ROWS, ITEMS)


def test_search_in_blocks_of_items_and_pieces_of_texts(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 100)
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, k=5, item_bytes=60).collect()]
    assert sorted(found, key=str) == ranked(ROWS, ITEMS, 5)


def vectors(seed: int = 2) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 0.15, 64)], 1, 0.5, 2) for n in range(300)]
    rows += [(300 + n, rows[n][1], 1, 0.5, 2) for n in range(20)] + rows[:3]
    flat = rows[5][1]
    rows += [(400, None, 0, 0.5, 2), (401, [0.1] * 63, 0, 0.5, 2), (402, [None, *flat[1:]], 0, 0.5, 2), (403, [float("nan"), *flat[1:]], 0, 0.5, 2),
             (404, [float("-inf"), *flat[1:]], 0, 0.5, 2), (405, [], 0, 0.5, 2), (None, flat, 0, 0.5, 2), (406, [0.0] * 64, 0, 0.5, 2)]
    return rows


VECTORS = vectors()


def clustered(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def told():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = told()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    at, inertia = told(), Counter()
    for d, n in at:
        inertia[n] += d
    most = 2 ** 63 - 1
    return sorted(((i, n, min(d, most), min(inertia[n], most), min(sum(inertia.values()), most),
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at)), key=str)


def told(rows):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [16_384, 50])
def test_clusters_equal_plain_rounds(spark, small, monkeypatch, chunk):
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    monkeypatch.setattr(clusters.encode, "__defaults__", (64, chunk))
    assert told(run(spark, "op13_", small)) == clustered(VECTORS)


def test_clusters_of_few_and_of_huge_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(n, [float(np.float32(x)) for x in rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 37)], 1, 0.5, 2) for n in range(60)]
    for name, some in (("huge", rows), ("few", VECTORS[:7])):
        folder = tables(spark, str(tmp_path / name), embeddings=some)
        assert told(run(spark, "op13_", folder)) == clustered(some)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(6)
    values = np.floor(rng.normal(0, 3, (500, 64)))
    values[:, 8:16] = values[rng.integers(0, 9, 500), 8:16]
    blocks = clusters.blocks_of(values)
    assert (np.concatenate([words[codes] for _, words, codes in blocks], axis=1) == values).all()
    assert max(words.shape[1] for _, words, _ in blocks) >= 8  # a block with few distinct subvectors is kept whole
