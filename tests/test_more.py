"""Blocked retrieval, canvas changes, entities, model places, stems, spans, chunks and loaders against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom import session
from memloom.functions import entities as N
from memloom.functions import temporal as T
from memloom.functions import text as X
from memloom.functions.stemming import stem
from memloom.operators import backends as B
from memloom.operators import blocks
from memloom.operators import canvas as C
from memloom.operators import entity_graph as EG
from memloom.operators import extraction as E
from memloom.operators import graph as G
from memloom.operators import retrieval as R
from memloom.operators import turns as W
from memloom.sources import conversations as J
from memloom.sources import generators as D


def _bm25(docs, question):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in question) for i, d in docs.items()}


@pytest.mark.parametrize("method", ["semantic", "bm25", "hybrid"])
def test_blocks_give_the_brute_force_top_k(spark, method):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = {f"d{k:03}": [rng.choice(words) for _ in range(rng.randint(1, 12))] for k in range(150)}
    docs["d150"] = docs["d007"]
    vecs = {i: np.array([rng.gauss(0, 1) for _ in range(4)]) for i in docs}
    vecs["d150"] = vecs["d007"]
    vecs = {i: v / np.linalg.norm(v) for i, v in vecs.items()}
    asked = {f"q{k}": ([rng.choice(words) for _ in range(4)], vecs[f"d{k:03}"] * (-1) ** k) for k in range(12)}
    d = spark.createDataFrame([("c", i, vecs[i].tolist(), t) for i, t in docs.items()] + [("e", "x", [1.0, 0.0, 0.0, 0.0], []), (None, "y", [1.0, 0.0, 0.0, 0.0], [])], "conv_id string, doc_id string, vec array<double>, tokens array<string>")
    q = spark.createDataFrame([("c", i, v.tolist(), t) for i, (t, v) in asked.items()] + [("none", "z", [1.0, 0.0, 0.0, 0.0], ["w1"])], "conv_id string, q_id string, vec array<double>, tokens array<string>")
    got = {}
    for r in R.ranked(blocks.scored(d, q, 5, method, dim=4, block_rows=20), 5).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.doc_id))
    for i, (t, v) in asked.items():
        lex = _bm25(docs, t)
        top = max(lex.values())
        lex = {k: round(x / top, 6) if x > 0 else 0.0 for k, x in lex.items()} if top > 0 else dict.fromkeys(lex, 0.0)
        sem = {k: round(float(v @ vecs[k]), 6) for k in docs}
        score = {"semantic": sem, "bm25": {k: x for k, x in lex.items() if x > 0}, "hybrid": {k: s for k in docs if (s := round(0.7 * sem[k] + 0.3 * lex[k], 7)) > 0}}[method]
        assert [x for _, x in sorted(got.get(i, []))] == sorted(score, key=lambda k: (-score[k], k))[:5], i
    assert "z" not in got
    assert blocks.scored(d.limit(0), q, 5, method, dim=4).count() == 0


def test_canvas_changes(spark):
    nodes = spark.createDataFrame([("c", "a", "x"), ("c", "b", "x"), ("c", "d", None)], "conv_id string, id string, content string")
    more = spark.createDataFrame([("c", "a", "other"), ("c", "n", "new"), ("c", "n", "new"), ("e", "a", "new")], nodes.schema)
    assert sorted((r.conv_id, r.id, r.content) for r in C.add(nodes, more).where("content <> 'x'").collect()) == [("c", "n", "new"), ("e", "a", "new")]
    asks = spark.createDataFrame([("c", "a", "b", "leads_to"), ("c", "a", "b", "leads_to"), ("c", "a", "z", "leads_to"), ("c", "a", "b", "likes"), ("c", "a", None, "references"), ("c", "b", "d", "references"), ("e", "a", "b", "leads_to")], "conv_id string, src string, dst string, relation string")
    done = C.link(nodes, asks)
    assert sorted((r.dst or "", r.relation, r.linked) for r in done.where("conv_id = 'c'").collect()) == [("", "references", False), ("b", "leads_to", True), ("b", "leads_to", True), ("b", "likes", False), ("d", "references", True), ("z", "leads_to", False)]
    edges = C.linked_edges(done)
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {("a", "b", "leads_to"), ("b", "a", "caused_by"), ("b", "d", "references")}
    arrays = {r.id: (r.references_ids, r.leads_to, r.caused_by) for r in C.with_arrays(nodes, edges).collect()}
    assert arrays == {"a": ([], ["b"], []), "b": (["d"], [], ["a"]), "d": ([], [], [])}
    gone = spark.createDataFrame([("a",)], "id string")
    assert [(r.src, r.dst) for r in C.remove_edges(edges, gone).collect()] == [("b", "d")] and C.remove(nodes, gone).count() == 2
    assert C.clear(nodes, spark.createDataFrame([("c",)], "conv_id string")).count() == 0


def test_topological_order_needs_no_cycle(spark):
    nodes = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "1"), ("d", "2"), ("d", "3")], "conv_id string, id string")
    e = spark.createDataFrame([("c", "1", "2", "leads_to"), ("d", "1", "2", "leads_to"), ("d", "2", "1", "leads_to")], "conv_id string, src string, dst string, relation string")
    assert sorted((r.conv_id, r.id, r.level) for r in G.topological_order(nodes, e).collect()) == [("c", "1", 0), ("c", "2", 1)]
    assert G.topological_order(nodes, e, "likes").count() == 0


def test_entities(spark):
    text = 'We told Mira that "the plan" costs $1,200.50 and 3 days; see https://a.example/x, mail a.b@c.org or 555-123-4567. The AWS bill is due March 3rd.'
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(N.keywords(F.col("t"))).collect()]
    assert {"$1,200.50", "3 days", "the plan", "https://a.example/x,", "a.b@c.org", "555-123-4567", "mira", "aws", "march 3rd"} <= set(got[0]) and "the" not in got[0] and got[1:] == [[], []]
    typed = {(x.name, x.type) for x in df.select(N.typed(F.col("t")).alias("e")).first().e}
    assert {("aws", "TECHNOLOGY"), ("3 days", "NUMBER"), ("$1,200.50", "NUMBER"), ("the plan", "CONCEPT")} <= typed


def test_entity_graph(spark):
    rows = [("c", 1, 1, "redis and docker", "ok"), ("c", 2, 2, "redis", "with flask and docker"), ("d", 3, 1, None, None)]
    m = EG.mentions(spark.createDataFrame(rows, "conv_id string, entry_id long, turn_id int, user_text string, assistant_text string"))
    nodes, links = EG.nodes(m), EG.links(m)
    assert {(r.name, tuple(r.turns)) for r in nodes.collect()} == {("redis", (1, 2)), ("docker", (1, 2)), ("flask", (2,))}
    assert {(r.a, r.b, r.n) for r in links.collect()} == {("docker", "redis", 2), ("docker", "flask", 1), ("flask", "redis", 1)}
    q = spark.createDataFrame([("c", "q", "is flask in use?")], "conv_id string, q_id string, question string")
    seeds = EG.match(nodes, q)
    assert [r.name for r in seeds.collect()] == ["flask"]
    picked = EG.expand(seeds, links, 1)
    assert {r.name for r in picked.collect()} == {"flask", "docker", "redis"}
    assert "flask --[related_to]--> redis" in EG.context(picked, nodes, links).first().block


def test_models_are_called_once_per_question_and_retried(spark):
    hits = spark.createDataFrame([("c", "q", f"d{k}", "what is it", None if k == 3 else "it " * k) for k in range(4)], "conv_id string, q_id string, doc_id string, question string, content string")
    assert [(r.doc_id, r.score) for r in B.rated(hits, lambda q, ds: [len(ds)] * len(ds)).orderBy("doc_id").collect()] == [(f"d{k}", 4.0) for k in range(4)]
    assert [r.doc_id for r in B.judged(hits, lambda q, ds: [10 * len(d) / 9 - 1 for d in ds], 5, 0.3).collect()] == ["d2"]
    calls = []

    def fails(kind):
        def call():
            calls.append(kind)
            raise kind

        return call

    for error, tries in ((TimeoutError(), 3), (ValueError("bad key"), 1), (RuntimeError("429 rate limit"), 3)):
        calls.clear()
        with pytest.raises(type(error)):
            B.retried(fails(error), 3, 0.0)()
        assert len(calls) == tries
    rows = spark.createDataFrame([("q", "a", "a", 0.2), ("q", None, "a", 0.2)], "question string, answer string, ground_truth string, f1 double")

    def judge(q, a, t):
        if not a:
            raise ValueError("none")
        return " correct "

    assert [r.verdict for r in B.answer_judged(rows, judge, "f1").collect()] == [1.0, 0.2]


def test_model_extraction(spark):
    turns = spark.createDataFrame([("c", 1, 1, "hi", "yes"), ("c", 2, 2, "bad", None)], "conv_id string, turn_id int, entry_id long, user_text string, assistant_text string")
    known = spark.createDataFrame([("c", "a", 1, "x" * 200)], "conv_id string, id string, turn_id int, content string")

    def model(text, shown):
        if "bad" in text:
            raise ValueError("no")
        return f'```json\n[{{"type": "decision", "content": "{len(shown[0])}"}}, {{"content": "b", "citation": "q"}}, {{"type": "odd", "content": "c"}}]\n```'

    got = [(r.obj_type, r.content, r.quote, r.confidence) for r in B.extract(turns, B.model_extractor(model, known)).collect()]
    assert got == [("decision", "100", "", 0.8), ("key_fact", "b", "q", 0.8)]
    broken = spark.createDataFrame([("no json",), (None,), ("{\"content\": \"one\"}",)], "said string")
    assert [r.content for r in E.parsed(broken, "said", []).collect()] == ["one"]


def test_resolvers_agree_or_take_the_surer(spark):
    k = spark.createDataFrame([("1", "a", 0.4), ("2", "a", 0.6), ("3", None, None)], "ref_id string, resolved_id string, confidence double")
    v = spark.createDataFrame([("1", "a", 0.7), ("2", "b", 0.5), ("3", None, 0.2)], k.schema)
    assert {r.ref_id: (r.resolved_id, r.confidence) for r in E.resolve_by_both(k, v).collect()} == {"1": ("a", 1.0), "2": ("a", 0.6), "3": (None, 0.2)}
    with pytest.raises(ValueError):
        E.resolve(k, v, "other")


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"), ("rate", "rate"), ("cease", "ceas"), ("it", "it"), ("", "")])
def test_stems(word, want):
    assert stem(word) == want


@pytest.mark.parametrize("text,want", [
    ("on 3rd May 2021, then May 4, 2022", ["3rd May 2021", "May 4, 2022"]), ("in Sept 2020 or 2031", ["2020", "2031"]), ("by 2024-03-05", ["2024-03-05"]), ("1999 and x2020", []),
    ("the week after 3 June", ["the week after 3 June"]), ("monday before 3 june 2020", ["monday before 3 june 2020"]), ("last Friday, next week; this evening", ["last Friday", "next week", "this evening"]),
    ("3 days ago and in 2 weeks", ["3 days ago", "in 2 weeks"]), ("lastly, yesterday's", ["yesterday"]), ("day", []),
])
def test_time_spans(text, want):
    assert [s[0] for s in T.find_spans(text)] == want


def test_chunks_stream_like_the_whole_text(spark):
    rng = random.Random(4)
    rows = [(c, t, 100 * t + len(c), "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 5, 300, 1500]))), None if t % 4 == 0 else "z" * rng.choice([1, 700])) for c in ("c", "dd") for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id string, turn_id int, entry_id long, user_text string, assistant_text string")
    got = {}
    for r in W.chunk_walk(df).collect():
        got.setdefault(r.conv_id, []).append((r.chunk, r.start, r.end, r.text, list(r.turns)))
    for conv in ("c", "dd"):
        text, spans = "", []
        for c, t, _, u, a in rows:
            if c == conv:
                line = f"[Turn {t}] User: {u or ''}\nAssistant: {a or ''}\n\n"
                spans.append((len(text), len(text) + len(line), t))
                text += line
        want, start = [], 0
        while start < len(text):
            end = min(start + 512, len(text))
            if end < len(text) and (at := text.rfind("\n", max(start, end - 102), end)) >= 0:
                end = at + 1
            want.append((len(want), start, end, text[start:end], [t for a, b, t in spans if b > start and a < end]))
            if end >= len(text):
                break
            start = end if end - 100 <= 0 or end - 100 >= end else end - 100
        assert sorted(got[conv]) == want


def test_lists_in_texts(spark):
    df = spark.createDataFrame([('Sure: ["one", null, " "] done',), ("- first question here\nno\nsecond question here",), (None,)], "t string")
    assert [r[0] for r in df.select(X.listed(F.col("t"))).collect()] == [["one"], ["- first question here", "second question here"], []]


def test_sessions_and_either_form(spark, tmp_path):
    raw = '{"id": "c", "conversation": {"speaker_a": "Ann", "speaker_b": "Bo", "session_2": [{"speaker": "Bo", "text": "x", "dia_id": "D2:1"}], "session_10": [{"speaker": "Ann", "text": "y"}], "session_10_date_time": "today"}}'
    (tmp_path / "s.json").write_text(raw)
    got = sorted((r.session, r.role, r.text, r.dia_id, r.session_datetime) for r in J.flattened(J.load_sessions(spark, f"file://{tmp_path}/s.json")).collect())
    assert got == [(2, "assistant", "x", "D2:1", None), (10, "user", "y", None, "today")]
    for k, text in enumerate(('{"a": 1}\n{"a": 2}', '[{"a": 1}, {"a": 2}]', '[\n{"a": 1},\n{"a": 2}\n]')):
        (tmp_path / f"e{k}.json").write_text(text)
        assert sorted(r.a for r in J.load_either(spark, f"file://{tmp_path}/e{k}.json", "a int").collect()) == [1, 2]


def test_generated_conversations(spark):
    rows = D.conversations(spark, 5, "long").collect()
    assert len(rows) == 1000 and {r.turn for r in rows if r.role == "fact"} == {10, 50, 100, 150} and all((r.difficulty is None) == (r.role != "fact") for r in rows)
    assert {r.turn for r in rows if r.role == "document"} == {t for t in range(20, 201, 20)} - {100}
    with pytest.raises(ValueError):
        D.conversations(spark, 1, "odd")


def test_shared_folder_is_named_on_a_cluster():
    class Context:
        master = "spark://x"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_tables_can_be_dropped(spark):
    session.drop_tables(spark)
    df = session.materialize(spark.range(3).toDF("x"), "t")
    path = re.sub(r"^file:/*", "/", df.inputFiles()[0].rsplit("/", 1)[0])
    import os

    assert os.path.isdir(path) and session.drop_tables(spark) == 1 and not os.path.isdir(path)
