import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import neighbours, packing, splitting, tokens


def brute_nearest(ids, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: [int(j) for j in ids[np.lexsort((ids, -np.round(s[n], 6)))][:k]] for n, i in enumerate(ids.tolist())}, s


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.5).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 8, 1), (9004, [float("nan")] * 16, 1), (5, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "id long, v array<float>, ckey int")
    got = {r.key: [n.id for n in r.neighbours] for r in neighbours.nearest(df, "id", "v", 10, 16, probe=400).collect()}
    want, _ = brute_nearest(np.arange(1500), unit, 10)
    assert set(got) == set(range(1500))
    assert np.mean([len(set(got[k]) & set(want[k])) / 10 for k in want]) >= 0.9
    assert all(len(v) == 10 and k not in v for k, v in got.items())


def test_neighbours_of_copies_and_few(spark):
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(40)] + [(100, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r.key: [n.id for n in r.neighbours] for r in neighbours.nearest(df, "id", "v", 10, 4).collect()}
    assert got[20] == list(range(10)) and got[3] == [0, 1, 2, *range(4, 11)] and got[100] == list(range(10))
    few = {r.key: [n.id for n in r.neighbours] for r in neighbours.nearest(df.where("id in (1, 100)"), "id", "v", 10, 4).collect()}
    assert few == {1: [100], 100: [1]}
    assert neighbours.nearest(df.limit(0), "id", "v", 10, 4).count() == 0


def test_large_cells_are_spread():
    ix = neighbours.Index(np.zeros((1, 2), np.float32), np.zeros((2, 2), np.float32))
    ix.lay_out({0: 100, 1: 10}, 30)
    assert list(ix.blocks_of(0)) == [0, 1, 2, 3] and list(ix.blocks_of(1)) == [4] and ix.n_blocks == 5


def test_near_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1500:] = x[:1500] + rng.normal(size=(1500, 16)) * 0.15
    x[2990:] = x[2990]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    want, s = brute_nearest(np.arange(3000), unit, 10)
    pairs = {(a, b) for a in want for b in want[a] if a < b and a in want[b] and s[a, b] >= 0.9}
    got = {(r.id_a, r.id_b) for r in neighbours.mutual_pairs(neighbours.near(df, "id", "v", 0.9, dim=16, block_rows=100)).collect()}
    assert len(pairs) > 1000 and got <= pairs and len(got) >= 0.9 * len(pairs)


def test_stated_queries_against_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[20], x[41] = x[21], x[40]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    from pyspark.sql import functions as F

    got = {r.key: [n.id for n in r.neighbours] for r in neighbours.nearest(df, "id", "v", 10, 16, queries=F.col("id") % 20 == 0).collect()}
    want, _ = brute_nearest(np.arange(400), x / np.linalg.norm(x, axis=1)[:, None], 10)
    assert set(got) == set(range(0, 400, 20)) and all(got[k] == want[k] for k in got)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n字。", max_size=2500))
def test_splitting_invariants(text):
    pieces = splitting.split(text)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= 512 for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c < b < d and 70 <= b - c <= 130


def test_splitting_table(spark):
    long = "[Turn 2] User: " + "word " * 80 + "\n[Turn 3] User: " + "other " * 60
    rows = [(1, long, [3, 2, 2, None], "x"), (1, long, [3, 2, 2, None], "x"), (2, None, [1], "x"), (3, "short", None, "x"), (4, "a" * 513, None, "x"), (5, "tail " * 120 + "[Turn 9] User: hi " + "yes " * 40, [9, 8], "x")]
    df = spark.createDataFrame(rows, "chunk_id long, content string, source_turns array<int>, key string")
    got = {}
    for r in splitting.split_items(df, "chunk_id", "content", "source_turns").orderBy("key", "piece").collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == {1, 4, 5}
    assert got[1][0].turns == [2] and got[1][-1].turns == [2, 3] and got[5][0].turns == [8] and got[4][0].turns is None
    with pytest.raises(ValueError):
        splitting.split_items(df, "chunk_id", "content", "source_turns", 100, 60)


def best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=150))
def test_plan_is_best_fit_decreasing(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    runs, bins = packing.plan({s: sizes.count(s) for s in set(sizes)}, capacity)
    rooms = [capacity] * bins
    for s in set(sizes):
        mine = sorted((r for r in runs if r[0] == s), key=lambda r: r[1])
        for rank in range(sizes.count(s)):
            _, start, lo, each = [r for r in mine if r[1] <= rank][-1]
            rooms[lo + (rank - start) // each] -= s
    assert sorted(rooms) == best_fit(sizes, capacity)


def test_packing_table(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(300)] + [7] * 200
    df = spark.createDataFrame([*enumerate(sizes), (900, 0), (901, 230), (3, sizes[3])], "key long, n_tokens long")
    got = packing.pack(df, 50).collect()
    assert len({(r.key, r.piece) for r in got}) == len(got)
    assert [r.bin_id for r in got if r.key == 900] == [None]
    assert sorted(r.n_tokens for r in got if r.key == 901) == [30, 50, 50, 50, 50]
    used = {}
    for r in got:
        if r.bin_id is not None:
            used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
    assert max(used.values()) <= 50
    assert sorted(50 - v for v in used.values()) == best_fit([*sizes, 50, 50, 50, 50, 30], 50)
    assert packing.pack(df.limit(0), 50).count() == 0


def test_tokens_round_trip_and_reference(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = [None, "", " ", "Hello, world!  it's 2024\r\n", "<|endoftext|> as text", "字节对编码 é ñ 🎉👩‍💻", "x" * 300, "Qaerrbrioolt " * 50, " 　tab\t", "ábc ﻿"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    encoded = tokens.encode(df, "doc_id", "text")
    got = {r.key: r.ids for r in encoded.collect()}
    assert got == {k: reference.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert {r.key: r.text for r in tokens.decode(encoded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghij", min_size=1, max_size=120))
def test_heap_merges_like_the_fold(word):
    ranks = tokens.read_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken")
    raw = word.encode()
    if raw in ranks:
        want = [ranks[raw]]
    else:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        want = [ranks[p] for p in parts]
    assert tokens.merge_by_heap(raw, ranks) == want
