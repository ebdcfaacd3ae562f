"""The pieces operators are made of, against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.samples import tables
from tidemark.llm import digests, neardups, packing, repeats, sharding
from tidemark.llm.components import components
from tidemark.llm.neardups import DISTANCE, PLACES, keys_of
from tidemark.llm.queries import QUERIES
from tidemark.llm.trie import EliasFano, Trie, quantise


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=0, max_size=200), st.lists(st.integers(0, 2**63), max_size=30))
def test_elias_fano(values, targets):
    ordered = np.array(sorted(values), np.uint64)
    coded = EliasFano(EliasFano.build(ordered))
    assert (coded.take(np.arange(len(ordered))) == ordered).all()
    wanted = np.array(sorted(targets), np.uint64)
    where, value = coded.successor(wanted)
    assert (where == np.searchsorted(ordered, wanted)).all()
    assert all(v == ordered[w] for w, v in zip(where, value) if w < len(ordered))


def test_elias_fano_over_many_blocks():
    values = np.cumsum(np.random.default_rng(1).integers(0, 50, 30_000)).astype(np.uint64)
    coded = EliasFano(EliasFano.build(values))
    at = np.arange(0, 30_000, 7)
    assert (coded.take(at) == values[at]).all()
    targets = np.arange(0, int(values[-1]) + 100, 11, dtype=np.uint64)
    assert (coded.successor(targets)[0] == np.searchsorted(values, targets)).all()


def test_trie_finds_exactly_its_pairs():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    contexts = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    pairs = sorted({(int(w), int(c)) for w, c in zip(rng.integers(0, len(words), 9000), rng.choice(contexts, 9000))})
    word, context = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64)
    trie = Trie.mapped(Trie.build(words, np.zeros(len(words)), np.zeros(len(words)), word, context, np.arange(len(pairs)) * 1.0, 16))
    assert (trie.find_words(words) == np.arange(len(words))).all()
    assert (trie.value("bigram", trie.find_pairs(word, context)) == np.arange(len(pairs))).all()
    everything = [(w, int(c)) for w in range(len(words)) for c in contexts]
    found = trie.find_pairs(np.array([e[0] for e in everything]), np.array([e[1] for e in everything], np.uint64))
    known = set(pairs)
    assert all((f >= 0) == (e in known) for f, e in zip(found, everything))


def test_quantised_values_stay_near():
    values = np.random.default_rng(3).normal(size=50_000)
    codes, table = quantise(values, 12)
    assert np.abs(table[codes] - values).mean() < 1e-3


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(30):
        held = [rng.randint(0, 90) for _ in range(rng.randint(1, 6))]
        shards = rng.randint(1, 7)
        capacity = [sum(held) // shards + (n < sum(held) % shards) for n in range(shards)]
        flow = sharding.min_cost_flow(held, capacity, lambda i, j: int(i != j))
        assert all(sum(u for (i, _), u in flow.items() if i == k) == h for k, h in enumerate(held))
        assert all(sum(u for (_, j), u in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(min(h, capacity[k]) if k < shards else 0 for k, h in enumerate(held))
        assert sum(u for (i, j), u in flow.items() if i != j) == sum(held) - stay


def test_flow_needs_room():
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], lambda i, j: 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=40))
def test_placing_fills_sequences(lengths):
    parts = packing.place(lengths, 10, 1.0, 0.1)
    assert [sum(p[3] for p in x) for x in parts] == lengths
    filled = {}
    for x in parts:
        for sequence, offset, _, length in x:
            filled.setdefault(sequence, []).append((offset, length))
    assert sum(10 - sum(n for _, n in v) for v in filled.values()) < 10
    assert all(sum(n for _, n in v) <= 10 and len({o for o, _ in v}) == len(v) for v in filled.values())


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, PLACES)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(PLACES, DISTANCE, replace=False)] ^= 1
        assert (keys_of(a) == keys_of(b)).any()


def test_components_of_a_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(100, 160)] + [(7, n) for n in range(300, 340)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: 100 for n in range(100, 161)} | {n: 7 for n in (7, *range(300, 340))}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_anchors_are_the_same_in_equal_strings():
    rng = random.Random(6)
    shared = bytes(rng.choices(b"abcd ", k=230))
    texts = [bytes(rng.choices(b"abcd ", k=n)) + shared + bytes(rng.choices(b"abcd ", k=40)) for n in (0, 13, 1000)]
    number, place, hashes = repeats.anchors(texts, repeats.Rolling(repeats.SEGMENT + 400))
    sets = [set(hashes[number == n].tolist()) for n in range(3)]
    assert sets[0] & sets[1] & sets[2]


def test_long_texts_are_seen_in_segments(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    text = bytes(random.Random(7).choices(b"abcdefgh", k=5000))
    number, place, _ = repeats.anchors([text], repeats.Rolling(2000))
    gaps = np.diff(np.unique(place))
    assert place.min() < 200 and place.max() > 4800 - 200 and gaps.max() <= repeats.LEFT + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), max_size=40))
def test_merged_spans(spans):
    key, begin, length = (np.array([s[k] for s in spans], np.int64) for k in range(3))
    found = list(zip(*(x.tolist() for x in repeats.merged(key, begin, begin + length))))
    expected = [(k, a, b) for k in range(4) for a, b in repeats.union([(s[1], s[1] + s[2]) for s in spans if s[0] == k])]
    assert sorted(found) == expected


def test_large_anchors_are_dealt_without_loss(spark):
    rng = random.Random(8)
    middle = "x" + "".join(rng.choices("abcdef", k=210))
    rows = [(n, "".join(rng.choices("ghij", k=150)) + middle + "".join(rng.choices("klmn", k=150))) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) AS key")
    spans = [{(r.key, r.begin, r.end) for r in repeats.repeats(docs, most=most).collect()} for most in (100_000, 5)]
    ends = [{k: (min(b for x, b, _ in s if x == k), max(e for x, _, e in s if x == k)) for k, *_ in s} for s in spans]
    assert len(ends[0]) == 30 and ends[0] == ends[1]
    assert all(begin <= 150 and end >= 361 for begin, end in ends[0].values())


def test_entropy_of_windows():
    texts = [bytes(random.Random(9).choices(range(40), k=n)) for n in (100, 5, 0, 32, 200)]
    data, starts, ends = digests.joined(texts)
    levels = digests.entropies(data, starts, ends)
    for text, start in zip(texts, starts):
        for k in range(len(text) - digests.WINDOW + 1):
            window = np.bincount(np.frombuffer(text[k:k + digests.WINDOW], np.uint8))
            share = window[window > 0] / digests.WINDOW
            assert abs(levels[start + k] - -(share * np.log2(share)).sum() / 5 * digests.STEPS) <= 1.01
    assert (levels >= 0).sum() == sum(max(0, len(t) - digests.WINDOW + 1) for t in texts)


def test_likeness():
    one = digests.filters(np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    none = digests.filters(np.zeros(0, np.uint64))
    assert digests.likeness(one, one) == 1.0 and digests.likeness(none, none) == 1.0 and digests.likeness(one, none) == 0.0


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(900, 12))
    vectors[40:60] = vectors[0]  # ties
    rows = [(n, v.astype(np.float32).tolist(), 1, 0.0, 1) for n, v in enumerate(vectors)]
    rows += [(2000, None, 1, 0.0, 1), (2020, [0.0] * 12, 1, 0.0, 1), (2040, [float("nan")] * 12, 1, 0.0, 1), (2060, [None] * 12, 1, 0.0, 1),
             (2080, [1.0, 2.0], 1, 0.0, 1), (None, [1.0] * 12, 1, 0.0, 1), (2100, [float("inf")] * 12, 1, 0.0, 1), rows[1], rows[20]]
    found = QUERIES["op3_multiprobe_neighbours"](spark, tables(spark, str(tmp_path / "v"), embeddings=rows)).collect()
    asked = [n for n in range(900) if n % 20 == 0]
    assert {r.query_id for r in found} == set(asked) and len(found) == 20 * len(asked)
    exact = vectors.astype(np.float32).astype(np.float64)
    hits = 0
    for query in asked:
        products = exact @ exact[query]
        order = [n for n in np.lexsort((np.arange(900), -np.round(products, 12))) if n != query][:20]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(products[v] - s) < 1e-9 for _, v, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hits += len({g[1] for g in got} & set(order))
    assert hits >= 0.9 * 20 * len(asked)
    few = tables(spark, str(tmp_path / "few"), embeddings=rows[:3])
    assert len(QUERIES["op3_multiprobe_neighbours"](spark, few).collect()) == 2
    assert QUERIES["op3_multiprobe_neighbours"](spark, tables(spark, str(tmp_path / "none"), embeddings=[])).collect() == []


def test_remaining_documents_meet_by_bucket_in_bounded_blocks(spark, monkeypatch):
    # 60 texts that share a third of their shingles, in one chain of buckets, and three pairs of duplicates among them
    rng = np.random.default_rng(9)
    common, texts = rng.integers(1, 1 << 62, 150, np.uint64), []
    for _ in range(60):
        texts.append(np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 150, np.uint64)])))
    for n in (3, 20, 41):
        texts.append(np.unique(np.concatenate([texts[n][:-5], rng.integers(1, 1 << 62, 5, np.uint64)])))
    signature = neardups.signatures(texts)
    sets = spark.createDataFrame([(n, s.tobytes(), t.tobytes()) for n, (s, t) in enumerate(zip(signature, texts, strict=True))],
                                 "node long, signature binary, set binary")
    listed = [(int(k), n) for n, row in enumerate(keys_of(signature).view(np.int64)) for k in row]
    often = Counter(k for k, _ in listed)
    left = spark.createDataFrame([(k, n, n) for k, n in listed if often[k] > 1], "key long, node long, component long")
    whole, plain, most = sum(t.nbytes for t in texts), neardups.linked_within, 25_000

    def bounded(rows, percent):
        held = sum(len(r[-1]) for r in rows)
        assert held < 4 * most < whole, held
        return plain(rows, percent)

    monkeypatch.setattr(neardups, "linked_within", bounded)
    found = components(neardups.remaining_links(left, sets, 80, most)).collect()
    assert {(r.node, r.component) for r in found if r.node != r.component} == {(60, 3), (61, 20), (62, 41)}


def test_block_pairs_meet_every_two_members_once(spark):
    rows = [(key, n, n) for key, size in ((1, 23), (2, 5), (3, 1)) for n in range(size)]
    members = spark.createDataFrame(rows, "key long, node long, component long")

    def pair(held):
        assert len(held) <= 23
        across = held[0][3] != held[-1][3]
        return [(a[1], b[1]) for i, a in enumerate(held) for b in held[i + 1:] if not across or a[3] != b[3]]

    told = Counter((r.a, r.b) if r.a < r.b else (r.b, r.a) for r in neardups.in_block_pairs(members, F.lit(1), 4, pair, ("a", "b")).collect())
    assert told == Counter((a, b) for size in (23, 5) for a in range(size) for b in range(a + 1, size))


def packed_like_tokenizers(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    ids = {n: np.array([*tool.encode(t, add_special_tokens=False).ids, 0], "<u4") for n, t in enumerate(texts)}
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    told = Counter()
    for r in found:
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()))
        told[r.doc_id] += r.length
    assert told == Counter({n: len(i) for n, i in ids.items()})


def test_very_long_runs_of_blanks_are_packed(spark):
    packed_like_tokenizers(spark, ["before" + " " * 2_000_000 + "after", "\n" * 1_200_000 + "word", "a\t \r\n" * 3 + "\xa0 \x85" * 500_000 + "b",
                                   " " * 49_999 + "short", " " * 50_000])


def test_added_tokens_in_a_text_get_their_own_id(spark):
    assert np.frombuffer(packing.Ids(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).of(
        "a <|endoftext|> b"), "<u2").tolist() == [64, 220, 50256, 275]
    packed_like_tokenizers(spark, ["a <|endoftext|> b", "<|endoftext|>" * 700, "中文 <|endoftext|>\n\n", "<|endoftext| >", "\xe9<|endoftext|>x"])


@pytest.mark.parametrize("size", [200, 231, 320, 700])
def test_a_very_frequent_passage_is_no_single_task(spark, monkeypatch, size):
    # the passage has its own surroundings in every text; some share a part of it or more than it
    rng = random.Random(size)
    passage, longer = rng.randbytes(size).hex()[:size], rng.randbytes(90).hex()
    texts = [f"{rng.randbytes(rng.randint(0, 200)).hex()}{passage}{rng.randbytes(rng.randint(0, 200)).hex()}" for _ in range(60)]
    texts += [f"{n}{rng.randbytes(40).hex()}{longer}{passage}{longer[:40 + 20 * n]}" for n in range(3)]
    texts += [f"{rng.randbytes(60).hex()}{passage[:size - n]}{rng.randbytes(60).hex()}" for n in (1, 20, 90)]
    texts += [passage, passage[1:]]
    docs = spark.createDataFrame([(n, t, n) for n, t in enumerate(texts)], "doc_id long, text string, key long").repartition(7)
    plain = repeats.maximal_repeats

    def bounded(before, rows, length):
        assert len(rows) < 50, len(rows)
        return plain(before, rows, length)

    monkeypatch.setattr(repeats, "maximal_repeats", bounded)
    found = {}
    for r in repeats.repeats(docs, joined=True, per_part=10, most=5).collect():
        found.setdefault(r.key, []).append((r.begin, r.end))
    seen = Counter(t[k:k + 200] for t in texts for k in range(len(t) - 199))
    expected = {n: repeats.union([(k, k + 200) for k in range(len(t) - 199) if seen[t[k:k + 200]] > 1]) for n, t in enumerate(texts)}
    assert {n: repeats.union(spans) for n, spans in found.items()} == {n: spans for n, spans in expected.items() if spans}


def in_small_batches(monkeypatch, module):
    plain = module.slices

    def bounded(batches, *limits):
        def look():
            for batch in batches:
                assert batch.nbytes < 6_000_000, batch.nbytes
                yield batch

        return plain(look(), *limits)

    monkeypatch.setattr(module, "slices", bounded)


def long_documents(spark, folder):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rng = random.Random(7)
    rows = [(n, " ".join(rng.randbytes(4).hex() for _ in range(550))) for n in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_long_texts_reach_the_repeats_by_bytes(spark, monkeypatch, tmp_path):
    folder = long_documents(spark, str(tmp_path / "long"))
    in_small_batches(monkeypatch, repeats)
    found = QUERIES["op8_interval_tree_repeats"](spark, folder).collect()
    assert len(found) == 3000 and all(r.n_removed == 0 and r.n_bytes == 4949 for r in found)
