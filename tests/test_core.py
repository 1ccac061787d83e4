import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.functions import temporal as T
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.operators import graph as G
from memloom.operators import metrics as M
from memloom.operators import retrieval as R
from memloom.operators import selection as P
from memloom.operators import turns as W
from memloom.plans.texts import artifacts

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    types = {k: ("double" if isinstance(v, float) else "array<double>" if isinstance(v, list) and v and isinstance(v[0], float) else "string") for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in types.items()))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.bm25_tokens(F.col("t")), t="Hello, World! it's fine") == ["hello", "world", "its", "fine"]
    assert one(spark, X.bm25_tokens(F.col("t")), t=None) == []
    assert one(spark, X.keyword_set(F.col("t")), t="éclair elan x1y the elan") == ["elan"]
    assert one(spark, X.normalised(F.col("t")), t="The  cat, a dog; An owl!") == "cat dog owl"
    assert one(spark, X.normalised(F.col("t")), t=None) == ""
    assert one(spark, X.complexity(F.col("t")), t="Why was it chosen?") == "complex"
    assert one(spark, X.adaptive_k(F.col("t"), 10), t="When is it due?") == 12
    assert one(spark, X.has_names(F.col("t"), 3), t="It ended. Then nothing") is False


@pytest.mark.parametrize("expression,want", [("yesterday", "7 May 2023"), ("tomorrow", "9 May 2023"), ("last week", "1 May 2023"), ("next week", "15 May 2023"), ("last month", "8 April 2023"), ("last year", "8 May 2022"), ("last monday", "1 May 2023"), ("last sunday", "7 May 2023"), ("3 days ago", "5 May 2023"), ("2 weeks ago", "24 April 2023"), ("1 month ago", "8 April 2023"), ("next year", None), ("last night", None), (None, None)])
def test_relative_times(spark, expression, want):
    stamp = T.session_time(F.lit("1:56 pm on 8 May, 2023"))
    assert one(spark, T.resolved(F.col("e"), stamp), e=expression) == want


def test_session_time_rejects(spark):
    assert one(spark, T.session_time(F.col("s")), s="1:56 pm on 8 Foo, 2023") is None
    assert one(spark, T.session_time(F.col("s")), s=None) is None


def test_spans_keep_the_longest():
    assert [s[0] for s in T.find_spans("on the sunday before 25 May 2023 and yesterday")] == ["the sunday before 25 May 2023", "yesterday"]
    assert T.find_spans(None) == []


def test_vectors(spark):
    got = one(spark, V.unit(V.hash_vector(F.col("t"))), t="test")
    assert [round(x / math.sqrt(24), 6) for x in got[:4]] == [-0.080783, 0.010567, -0.013975, 0.052833]
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0]) == 0


def test_bm25_floor_and_degenerate(spark):
    def scores(docs, question):
        d = spark.createDataFrame([("c", str(k), t) for k, t in enumerate(docs)], "conv_id string, doc_id string, t string").select("conv_id", "doc_id", X.bm25_tokens(F.col("t")).alias("tokens"))
        q = spark.createDataFrame([("c", "q", question)], "conv_id string, q_id string, t string").select("conv_id", "q_id", X.bm25_tokens(F.col("t")).alias("tokens"))
        return {r.doc_id: r.score for r in R.retrieve(d, q, 5, "bm25").collect()}

    assert scores(["a b"], "a") == {}
    assert scores(["paris trip", "france pendant found", "canada lake"], "france pendant") == {"1": 1.0}
    assert scores([], "x") == {}


def test_fusion_and_ranks(spark):
    a = spark.createDataFrame([("c", "q", "x", 0.8)], "conv_id string, q_id string, doc_id string, score double")
    b = spark.createDataFrame([("c", "q", "x", 0.8), ("c", "q", "x", 0.5), ("c", "q", "x", 0.5)], a.schema)
    assert R.merged_expansions(b, 5).first().score == pytest.approx(0.88)
    r = spark.createDataFrame([("c", "q", "x", 1)], "conv_id string, q_id string, doc_id string, rank int")
    assert R.reciprocal_ranks([r, r.withColumn("rank", F.lit(3))]).first().score == pytest.approx(1 / 61 + 1 / 63, abs=1e-8)
    with pytest.raises(ValueError):
        R.retrieve(a, a, 5, "keyword")


def _edges(spark, pairs, relation="leads_to"):
    return spark.createDataFrame([("c", a, b, relation) for a, b in pairs], "conv_id string, src string, dst string, relation string")


def test_walks(spark):
    chain = _edges(spark, [("0", "1"), ("1", "2"), ("2", "3"), ("3", "4")])
    start = spark.createDataFrame([("c", "2")], "conv_id string, start string")
    assert {r.node for r in G.walk(chain, start, 1, both_ways=True).collect()} == {"1", "3"}
    assert {r.node for r in G.walk(G.mirrored(chain), start, 2).collect()} == {"0", "1", "3", "4"}
    diamond = _edges(spark, [("0", "1"), ("1", "2"), ("0", "3"), ("3", "2")])
    got = G.walk(diamond, spark.createDataFrame([("c", "0")], "conv_id string, start string"), 3).where("node = '2'").first()
    assert (got.hops, got.path) == (2, "0>1>2")


def _bfs(steps, start, hops=None):
    """{node: (hops, path)}: shortest, of these the path that sorts first."""
    best, layer, hop = {start: (0, start)}, {start: start}, 0
    while layer and hop != hops:
        hop, ahead = hop + 1, {}
        for node, path in layer.items():
            for b in steps.get(node, ()):
                if b not in best:
                    ahead[b] = min(ahead.get(b, f"{path}>{b}"), f"{path}>{b}")
        best |= {b: (hop, path) for b, path in ahead.items()}
        layer = ahead
    return {b: x for b, x in best.items() if b != start}


def test_walk_without_a_limit(spark):
    pairs = [(f"n{k:02}", f"n{k + 1:02}") for k in range(18)] + [("n18", "n10"), ("n03", "a"), ("a", "n05"), ("n00", "n00")]
    steps = {}
    for a, b in pairs:
        steps.setdefault(a, []).append(b)
    starts = spark.createDataFrame([("c", "n00"), ("c", "n12")], "conv_id string, start string")
    got = {(r.start, r.node): (r.hops, r.path) for r in G.walk(_edges(spark, pairs), starts, None).collect()}
    assert got == {(s, b): x for s in ("n00", "n12") for b, x in _bfs(steps, s).items()} and got["n00", "n18"][0] == 18


def test_paths_and_khops_from_every_artifact(spark):
    a = artifacts(spark, SF)
    ids, e = [r.id for r in a.select("id").collect()], G.edges(a)
    for name, rows, hops, both in (("g7_shortest_paths", G.mirrored(e).collect(), None, False), ("g6_khop", e.collect(), 2, True)):
        steps = {}
        for r in rows:
            steps.setdefault(r.src, set()).add(r.dst)
            if both:
                steps.setdefault(r.dst, set()).add(r.src)
        got = sorted((r.start, r.node, r.hops) for r in entry.queries()[name](spark, SF).collect())
        assert got == sorted((s, b, x[0]) for s in ids for b, x in _bfs(steps, s, hops).items()), name


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([("c", str(k)) for k in range(6)], "conv_id string, id string")
    got = {r.id: r.level for r in G.levels(nodes, _edges(spark, [("0", "1"), ("0", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("5", "4")])).collect()}
    assert got == {"0": 0, "1": 1, "2": 1, "3": 2, "4": None, "5": None}


def test_levels_of_a_long_chain(spark):
    nodes = spark.createDataFrame([("c", f"n{k}") for k in range(103)] + [("c", "x"), ("c", "y")], "conv_id string, id string").coalesce(1)
    e = _edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(102)] + [("x", "y"), ("y", "x")]).coalesce(1)
    got = {r.id: r.level for r in G.levels(nodes, e).collect()}
    assert got == {f"n{k}": k for k in range(103)} | {"x": None, "y": None}


def test_expansion_decay(spark):
    hits = spark.createDataFrame([("c", "q", "0", 1, 1.0)], "conv_id string, q_id string, doc_id string, rank int, score double")
    chain = _edges(spark, [("0", "1"), ("1", "2"), ("2", "3")])
    assert {r.doc_id: r.score for r in G.expansion(hits, chain, 3).collect()} == {"1": 0.8, "2": 0.512, "3": 0.262144}
    assert {r.doc_id: r.score for r in G.seed_expansion(hits, chain, 3).collect()} == {"1": 0.8, "2": 0.64, "3": 0.512}


def test_expansion_scores_by_the_first_visit(spark):
    """The better seed visits first; a node both reach takes its score, even if the other would give more."""
    hits = spark.createDataFrame([("c", "q", "a", 1, 0.5), ("c", "q", "b", 2, 1.0)], "conv_id string, q_id string, doc_id string, rank int, score double")
    e = _edges(spark, [("a", "x"), ("b", "x"), ("b", "y")])
    assert {r.doc_id: r.score for r in G.expansion(hits, e, 2).collect()} == {"x": 0.4, "y": 0.8}


def test_budget_ends_at_first_overflow(spark):
    rows = spark.createDataFrame([("c", "a", "x" * 80, None, 3.0), ("c", "b", "x" * 200, None, 2.0), ("c", "d", "", None, 1.0)], "conv_id string, id string, content string, quote string, confidence double")
    got = P.within_budget(P.injection_order(rows, "confidence"), 85)
    assert [r.id for r in got.collect()] == ["a"]


def test_partial_ratio_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    def brute(a, b):
        s, t = sorted((a, b), key=len)
        if not s:
            return 100.0 if not t else 0.0
        return max(200 * lcs(s, w) / (len(s) + len(w)) for k in range(-len(s) + 1, len(t)) if (w := t[max(0, k) : k + len(s)]))

    for a, b in [("abc", "xxabcxx"), ("kitten", "sitting here"), ("", ""), ("", "a"), ("aws due", "to budget aws"), ("ab", "ba")]:
        assert M.partial_ratio(a, b) == pytest.approx(brute(a, b))


def test_turns_and_chunks(spark):
    rows = [("c", 1, 1, "hi", ""), ("c", 2, 2, "there", "hello"), ("c", 3, 3, None, "more"), ("d", 1, 4, "x" * 900, "y" * 900)]
    e = spark.createDataFrame(rows, "conv_id string, turn_id int, entry_id long, user_text string, assistant_text string")
    got = {(r.conv_id, r.turn): (r.user, r.assistant) for r in W.turns(W.messages(e)).collect()}
    assert got[("c", 1)] == ("hi\nthere", "hello\nmore")
    chunks = [r for r in W.chunk_walk(e).collect() if r.conv_id == "d"]
    assert all(len(c.text) <= 512 for c in chunks) and chunks[-1].end == max(c.end for c in chunks) and chunks[0].turns == [1]
