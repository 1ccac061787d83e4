"""Layouts and block operators that hold at any size, each against the plain way on small rows."""

import os

from memloom.sources import canvas_json as J


def _files(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def test_saved_canvas_has_few_files_and_keeps_its_keys(spark, tmp_path):
    rows = [(f"{k:03d}", f"i{n}", f"text {n}") for k in range(60) for n in range(3)] + [("", "i0", "a"), (None, "i1", "b"), ("2024-01-01", "i2", "c")]
    path = f"{tmp_path}/canvas"
    J.save(spark.createDataFrame(rows, "conv_id string, id string, content string").repartition(4), path)
    assert len(_files(path)) <= 8  # not one or more per conversation
    got = J.load(spark, path)
    assert dict(got.dtypes)["conv_id"] == "string"
    assert sorted(map(str, [(r.conv_id, r.id, r.content) for r in got.collect()])) == sorted(map(str, rows))


def test_state_is_there_after_a_save_of_many_conversations(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert not J.has_state(spark, path)
    J.save(spark.range(500).selectExpr("cast(id as string) as conv_id", "'i' as id"), path)
    assert J.has_state(spark, path) and len(_files(path)) <= 8 and J.load(spark, path).count() == 500


def test_loaded_state_joins_its_edges_by_keys_as_they_were(spark, tmp_path):
    nodes = spark.createDataFrame([("007", "a", 1), ("007", "b", 2), ("", "a", 3)], "conv_id string, id string, turn_id int")
    edges = spark.createDataFrame([("007", "a", "b", "references")], "conv_id string, src string, dst string, relation string")
    J.save_state(nodes, edges, f"{tmp_path}/s")
    n, e = J.load_state(spark, f"{tmp_path}/s")
    assert sorted((r.conv_id, r.id) for r in n.join(e, "conv_id", "left_semi").collect()) == [("007", "a"), ("007", "b")]
    assert n.where("conv_id = ''").count() == 1


def _resolved(refs, cands):
    """By hand: every reference with every candidate of its conversation."""
    out = {}
    for conv, ref, hint, words, _ in refs:
        rows = []
        for c, i, kind, turn, cw, _ in cands:
            if c == conv:
                part = 0.1 / (1 + 0.1 * turn) if turn is not None else 9.0
                share = len(set(words) & set(cw)) / len(set(words)) if words else 0.0
                rows.append((-round(min(1.0, (0.3 if hint == kind else 0.0) + 0.5 * share + part), 6), turn if turn is not None else 1 << 31, i))
        best = min(rows, default=(0.0, 0, None))
        out[ref] = (best[2], -best[0]) if -best[0] >= 0.3 else (None, None)
    return out


def _rows(spark, seed, turns):
    import random

    r, vocabulary = random.Random(seed), ["alpha", "beta", "gamma", "delta", "epsilon"]
    unit = lambda: (lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v])([r.gauss(0, 1) for _ in range(16)])
    pick = lambda: r.sample(vocabulary, r.randint(0, 3))
    cands = [(f"c{k % 3}", f"i{k:02d}", r.choice(["todo", "event", "decision"]), r.choice(turns), pick(), unit()) for k in range(40)]
    refs = [(f"c{k % 4}", f"r{k}", r.choice(["todo", "event", "reminder", None]), pick(), unit()) for k in range(40)]
    both = spark.createDataFrame(refs, "conv_id string, ref_id string, hint string, words array<string>, vec array<double>"), spark.createDataFrame(cands, "conv_id string, id string, obj_type string, turn_id int, words array<string>, vec array<double>")
    return refs, cands, both


def test_resolver_by_words_counts_candidates_without_a_shared_word_or_type(spark):
    from memloom.operators import extraction as E

    refs, cands, both = _rows(spark, 1, [0, 1, 5, 5, 40, -9, None])
    got = {r.ref_id: (r.resolved_id, r.confidence) for r in E.resolve_by_keywords(*both).collect()}
    assert got == _resolved(refs, cands)


def _with_small(answers, small):
    """The same function with another bound of small conversations, on the workers too."""

    def made(*args):
        run = answers.__wrapped__(*args) if hasattr(answers, "__wrapped__") else answers(*args)

        def bound(batches):
            from memloom.operators import resolving

            resolving.SMALL = small
            yield from run(batches)

        return bound

    made.__wrapped__ = getattr(answers, "__wrapped__", answers)
    return made


def test_resolvers_do_not_depend_on_blocks(spark, monkeypatch):
    from memloom.operators import resolving

    refs, cands, both = _rows(spark, 2, [1, 2, 3, 5, 8])
    for rows, small in ((3, 0), (8192, 0), (8192, 64)):
        monkeypatch.setattr(resolving, "_answers", _with_small(resolving._answers, small))
        got = {r.ref_id: r for r in resolving.best(*both, True, True, block_rows=rows).collect()}
        assert {k: (r.k.id, r.k.confidence) if r.k else (None, None) for k, r in got.items()} == _resolved(refs, cands)
        for conv, ref, hint, _, v in refs:
            own = [c for c in cands if c[0] == conv]
            own = [c for c in own if c[2] == hint] or own
            want = min(((-round(sum(a * b for a, b in zip(v, c[5])), 6), c[1]) for c in own), default=None)
            assert (want is None and got[ref].v is None) or (got[ref].v.id, got[ref].v.confidence) == (want[1], -want[0])


def test_references_share_one_search(spark):
    from memloom.operators import extraction as E

    _, _, both = _rows(spark, 3, [1, 2, 3])
    each = E.resolve_each(*both, ["keyword", "embedding", "hybrid"])
    plans = [d._jdf.queryExecution().toString() for d in each.values()]
    assert all("MapInArrow" not in p for p in plans)
    assert {r.ref_id: r.resolved_id for r in each["hybrid"].collect()} == {r.ref_id: r.resolved_id for r in E.resolve(*both, "hybrid").collect()}


def test_relation_rule_1_does_not_depend_on_blocks(spark, monkeypatch):
    import random

    from memloom.operators import graph as G
    from memloom.operators import relating

    r, words = random.Random(4), ["alpha", "beta", "gamma", "delta"]
    unit = lambda: (lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v])([r.gauss(0, 1) for _ in range(16)])
    rows = [(f"c{k % 2}", f"i{k:02d}", r.choice([1, 2, 3, 3, None]), "todo", unit(), r.sample(words, 2), r.sample(words, 1)) for k in range(60)]
    f = spark.createDataFrame(rows, "conv_id string, id string, turn_id int, obj_type string, vec array<double>, kw_all array<string>, kw_content array<string>")
    want = set()
    for n in rows:
        for o in rows:
            if n[0] == o[0] and None not in (n[2], o[2]) and o[2] < n[2]:
                sim = round(sum(a * b for a, b in zip(n[4], o[4])), 6)
                if sim >= 0.5 or (sim >= 0.3 and set(n[5]) & set(o[6])):
                    want.add((n[1], o[1]))
    assert len(want) > 20
    for rows_of_block in (7, 1536):
        got = relating.references(f, 0.5, 0.3, block_rows=rows_of_block).collect()
        assert len(got) == len(want) and {(x.src, x.dst) for x in got} == want
    assert "Join" not in G.relation_rule(f, 1)._jdf.queryExecution().analyzed().toString().replace("Join LeftOuter", "")  # no pair is a row of a join
    import numpy as np

    many = [[w for w in words if r.random() < 0.3] for _ in range(30)]
    a, b = np.nonzero(np.ones((30, 30), bool))
    alone = relating._share(many, many, a, b)
    monkeypatch.setattr(relating, "ONE_BY_ONE", 0)
    assert (relating._share(many, many, a, b) == alone).all()


def test_agent_contexts_retrieve_each_question_only_by_its_path(spark, monkeypatch):
    from memloom.operators import blocks
    from memloom.plans import agents

    calls, scored = [], blocks.scored
    monkeypatch.setattr(blocks, "scored", lambda d, q, k, method, *a, **kw: calls.append(method) or scored(d, q, k, method, *a, **kw))
    agents.q22_agent_contexts(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["bm25", "hybrid"]
