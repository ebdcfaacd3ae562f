"""Every operator on documents against a brute-force version, on a small table of awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.samples import document_rows, tables
from tidemark.llm import language, scoring
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = document_rows()


def run(spark, prefix, sf_dir):
    return QUERIES[next(n for n in QUERIES if n.startswith(prefix))](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("small")), documents=ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("empty")), documents=[])


def lowered(text):
    return [w.encode().lower() for w in WORD.findall(text or "")]


@pytest.mark.parametrize("prefix", ["op2_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"])
def test_empty_table(spark, empty, prefix):
    assert run(spark, prefix, empty) == []


@pytest.mark.parametrize("tokens_per_part", [2_000_000, 400])
def test_scores_equal_a_plain_bigram_model(spark, small, monkeypatch, tokens_per_part):
    """In one part, and in many with frequent words dealt by pair."""
    monkeypatch.setitem(scoring.score.__kwdefaults__, "tokens_per_part", tokens_per_part)
    single, pairs, trained = Counter(), Counter(), 0
    for doc_id, text, *_ in ROWS:
        words = [*lowered(text), b" end"]
        if zlib.crc32(str(doc_id).encode()) % 5 != 1:
            trained += 1
            single.update(words)
            pairs.update(zip([b" begin", *words], words))
    total = sum(single.values())
    base = total + 0.5 * (len(single) + 1)
    expected = []
    for doc_id, text, *_ in ROWS:
        words = [*lowered(text), b" end"]
        plain = sum(math.log10((single[w] + 0.5) / base) for w in words)
        model = sum(math.log10((pairs[v, w] + 400 * (single[w] + 0.5) / base) / ((trained if v == b" begin" else single[v]) + 400))
                    for v, w in zip([b" begin", *words], words))
        expected.append((doc_id, zlib.crc32(str(doc_id).encode()) % 5 == 1, len(words), sum(single[w] > 0 for w in words), total,
                         round(plain, 6), round(model, 3)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3))
             for r in run(spark, "op2_", small)]
    assert sorted(found) == sorted(expected)


def water_filled(sizes, weights, share=1.5):
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        targets = {s: 2 * sizes[s] if s in capped else rest * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in capped and targets[s] > 2 * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_mix_meets_the_targets(spark, small):
    source = {r[0]: r[3] for r in ROWS}
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water_filled(sizes, {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)})
    found = run(spark, "op4_", small)
    assert len(found) == len(ROWS)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    # repeated rows share what is left to the word
    assert all(abs(taken[s] - targets[s]) <= 3 for s in targets)
    assert sorted(found) == sorted(run(spark, "op4_", small))


def shingles(text, n):
    words = lowered(text)
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def groups(rows, n):
    sets = {r[0]: shingles(r[1], n) for r in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates_equal_all_pairs(spark, small):
    expected = groups(ROWS, 4)
    found = run(spark, "op5_", small)
    assert len(found) == len(ROWS)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)
    assert sum(not r.kept for r in found) > 10


def test_packing_is_an_exact_round_trip(spark, small):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, "op6_", small):
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter(r[0] for r in ROWS)
    for doc_id, text in {r[0]: r[1] for r in ROWS}.items():
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(p[1] for p in pieces[doc_id]) == copies[doc_id] * len(ids)
        seen = Counter()
        for start, length, crc, total in pieces[doc_id]:
            assert total == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            seen.update(range(start, start + length))
        assert set(seen.values()) == {copies[doc_id]}
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padded += 1024 - at
    assert padded < 1024 * spark.read.parquet(f"{small}/documents.parquet").rdd.getNumPartitions()


def test_shards_are_level_and_gapless(spark, small):
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    found = run(spark, "op7_", small)
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in ROWS)
    shards, home = defaultdict(list), defaultdict(set)
    for r in found:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        shards[r.shard].append((r.slot, r.size))
        if text[r.doc_id]:
            home[text[r.doc_id]].add(r.shard)
    assert all(0 <= s < 8 for s in shards) and all(len(h) == 1 for h in home.values())
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in shards.values())


def test_repeats_equal_the_windows_that_occur_twice(spark, small):
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    seen = Counter(t[k:k + 200] for t in ((r[1] or "").encode() for r in ROWS) for k in range(len(t) - 199))
    for r in run(spark, "op8_", small):
        data = text[r.doc_id]
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 199):
            if seen[data[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_digests_of_edited_texts(spark, small):
    # rows alike in id and text follow each other
    ordered = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0], r[1] or ""))
    expected = Counter()
    for (doc_id, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        expected[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()] += 1
    found = run(spark, "op9_", small)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    texts = {r[0]: r[1] or "" for r in ROWS}
    prints = defaultdict(set)
    for r in found:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in found if r.n_chars > 400 and r.doc_id < 40]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_language_of_held_out_texts(spark, small):
    found = run(spark, "op10_", small)
    assert len(found) == len(ROWS)
    rows = {r[0]: r for r in ROWS}
    sure = [r for r in found if r.held_out and r.doc_id < 40 and rows[r.doc_id][2]]
    assert sure and np.mean([r.lang_pred == rows[r.doc_id][2] for r in sure]) >= 0.9
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        has_letter = any(c.isalpha() for c in rows[r.doc_id][1] or "")
        assert (r.lang_pred in ("de", "en")) if has_letter else (r.lang_pred == "und")
        assert 0 <= r.score <= 1


def test_equal_and_narrow_sizes_are_rejected(spark):
    same = b"alpha beta gamma delta " * 40
    docs = spark.createDataFrame([(1, "zq"), (2, "alpha beta gamma"), (3, "omega alpha " * 30)], "doc_id long, text string")
    found = language.identify(docs, {"x": same, "y": same}).collect()
    assert [(r.lang_pred, r.rejected) for r in found] == [("x", True)] * 3
    told = language.identify(docs, {"x": same, "y": b"nothing of the kind, not a word " * 30}).collect()
    assert [(r.lang_pred, r.rejected) for r in told if r.doc_id == 2] == [("x", False)]


def test_numbers_are_no_letters():
    assert [language.letters(t) for t in ("½ ² ①", "Ⅷ", "12", "a²b", "École _x")] == ["", "", "", "a b", "école x"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_texts_share_a_level_shard(spark, sf):
    home, size = defaultdict(set), Counter()
    for r in run(spark, "op7_", f"/root/testdata/{sf}"):
        home[r.size, r.text_crc32].add(r.shard)
        size[r.shard] += r.size
    assert all(len(h) == 1 for h in home.values())
    assert len(size) == 8 and max(size.values()) - min(size.values()) < 0.02 * sum(size.values())
