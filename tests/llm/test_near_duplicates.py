import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import near_duplicates as N
from memloom.llm.components import components

VOCABULARY = [f"w{k}" for k in range(400)]


def brute(rows, num=7, den=10, least=24):
    sets = {}
    for i, c, q in rows:
        if i is not None:
            sets[i] = frozenset(re.findall(r"[^\W_]+", f"{c or ''} {q or ''}".lower()))
    ids = sorted(i for i, s in sets.items() if len(s) >= least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


def edited(rng, words):
    words = [w for w in words if rng.random() > 0.1] + rng.sample(VOCABULARY, rng.randint(0, 5))
    rng.shuffle(words)
    return words


def pairs(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, content string, quote string, skey string")
    return {(r.id_a, r.id_b) for r in N.near_duplicate_pairs(df, "id", ["content", "quote"], **more).collect()}


def test_same_as_brute_force(spark):
    rng, rows = random.Random(5), []
    for base in range(40):
        words = rng.sample(VOCABULARY[: 60 if base < 10 else 400], rng.choice([20, 24, 30, 45, 70, 90]) if base >= 10 else 30)
        for k in range(4):
            w = edited(rng, words)
            rows.append((f"{base}-{k}", " ".join(w[:10]), " ".join(w[10:]).upper()))
    rows += [("copy1", *rows[3][1:]), ("copy2", *rows[3][1:]), rows[7], ("null", None, None), (None, *rows[3][1:]), ("long", " ".join(f"t{k}" for k in range(3000)), None), ("long2", " ".join(f"t{k}" for k in range(100, 3100)), "")]
    want = brute(rows)
    assert want and pairs(spark, rows) == want


def test_large_classes_become_stars(spark):
    text = " ".join(VOCABULARY[:30])
    rows = [(f"c{k:02}", text, None) for k in range(9)] + [("near", text + " other", None)]
    got = pairs(spark, rows, expand=5)
    assert got == {("c00", f"c{k:02}") for k in range(1, 9)} | {("c00", "near")}


def test_empty_and_classes(spark):
    assert pairs(spark, []) == set()
    text = " ".join(VOCABULARY[:30])
    other = " ".join(VOCABULARY[100:130])
    df = spark.createDataFrame([("a", text), ("b", text), ("c", text + " more"), ("d", other), ("a", text)], "id string, content string")
    got = {r.id: (r.class_id, r.copies, r.links, r.group_id) for r in N.near_duplicate_classes(df, "id", ["content"]).collect()}
    assert got == {"a": ("a", 2, 1, "a"), "b": ("a", 2, 1, "a"), "c": ("c", 1, 1, "a"), "d": ("d", 1, 0, "d")}


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5), (None, 3), (1000, 1001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in links:
        if x is not None and x != y:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "p long, q long"), "p", "q").collect()}
    assert got == {x: find(x) for x in list(root)} and got[1060] == 1000
    assert components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(24, 400), st.integers(24, 400))
def test_distance_bound(r, s):
    scheme = N.Scheme(7, 10, 24)
    bound = int(scheme.distance(r, s))
    most = max((r + s - 2 * o for o in range(min(r, s) + 1) if 10 * o >= 7 * (r + s - o)), default=None)
    assert most is None or most == bound
