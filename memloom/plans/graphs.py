"""Queries of the artifact graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.operators import graph as G
from memloom.operators import retrieval as R
from memloom.plans import sqltext as Q
from memloom.plans.retrieval import _LEX, _base, _best, _hash, docs, questions
from memloom.plans.texts import artifacts, entries


def g2_mirrored_edges(spark, folder):
    return G.mirrored(G.edges(artifacts(spark, folder)))


def g5_neighbours(spark, folder):
    return G.neighbours(G.edges(artifacts(spark, folder))).select("id", "neighbour", "ord")


def g6_khop(spark, folder):
    a = artifacts(spark, folder)
    return G.walk(G.edges(a), a.select("conv_id", F.col("id").alias("start")), 2, both_ways=True).select("start", "node", "hops")


def g7_shortest_paths(spark, folder):
    a = artifacts(spark, folder)
    return G.walk(G.mirrored(G.edges(a)), a.select("conv_id", F.col("id").alias("start")), None).select("start", "node", "hops", "path")


def g8_roots(spark, folder):
    a = artifacts(spark, folder)
    return G.without_incoming(a.select("conv_id", "id"), G.edges(a).where("relation = 'leads_to'")).select("id")


def g9_leaves(spark, folder):
    a = artifacts(spark, folder)
    return G.without_outgoing(a.select("conv_id", "id"), G.mirrored(G.edges(a))).select("id")


def g10_topological_order(spark, folder):
    """Nodes by causal level, of the conversations whose causal links have no cycle; of the others there is no order."""
    a = artifacts(spark, folder)
    return G.topological_order(a.select("conv_id", "id"), G.mirrored(G.edges(a)), "leads_to").select("id", "level")


def g11_graph_size(spark, folder):
    a = artifacts(spark, folder)
    e = G.mirrored(G.edges(a)).groupBy("conv_id").agg(F.count("*").alias("n_edges"))
    return a.groupBy("conv_id").agg(F.count("*").alias("n_nodes")).join(e, "conv_id", "left").select("conv_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def g20_causal_chains(spark, folder):
    a = artifacts(spark, folder)
    starts = a.where("obj_type = 'decision'").select("conv_id", F.col("id").alias("start"))
    chain = G.walk(G.mirrored(G.edges(a)).where("relation = 'caused_by'"), starts, 3)
    return chain.groupBy("start").agg((F.count("*") + 1).alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hops", "node"))), lambda x: x["node"]), ",").alias("chain"))


def g21_cooccurrence(spark, folder):
    return G.cooccurrence(entries(spark, folder), "entry_id", "keywords")


def g22_top_decisions(spark, folder):
    a = artifacts(spark, folder)
    d = a.where("obj_type = 'decision'").select("conv_id", "id").join(G.degrees(G.edges(a)), ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("degree", F.lit(0)).alias("degree"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("degree"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def g24_links(spark, folder):
    e = G.edges(artifacts(spark, folder))
    back = F.col("relation") == "caused_by"
    return e.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("source"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("target"), "relation")


def q5_graph_expansion(spark, folder):
    a = artifacts(spark, folder)
    hits = R.retrieve(docs(spark, folder), questions(spark, folder), 5, "bm25")
    return G.expansion(hits, G.mirrored(G.edges(a)), 3).select("q_id", "doc_id", "hops", "score")


def q15_multihop_expansion(spark, folder):
    a = artifacts(spark, folder)
    hits = R.retrieve(docs(spark, folder), questions(spark, folder), 5, "bm25")
    return G.seed_expansion(hits, G.edges(a), 2).select("q_id", "doc_id", "hops", "score")


def _rule(n: int):
    def run(spark, folder):
        return G.relation_rule(G.featured(artifacts(spark, folder)), n).select("src", "dst", "relation")

    return run


_EDGES = f"""WITH RECURSIVE {Q.ART},
raw AS (SELECT conv_id, id AS src, 'references' AS relation, unnest(references_ids) AS r FROM art
  UNION ALL SELECT conv_id, id, 'leads_to', unnest(leads_to) FROM art UNION ALL SELECT conv_id, id, 'caused_by', unnest(caused_by) FROM art),
e AS (SELECT DISTINCT conv_id, src, lower(regexp_replace(r, '^\\s+|\\s+$', '', 'g')) AS dst, relation FROM raw WHERE (conv_id, lower(regexp_replace(r, '^\\s+|\\s+$', '', 'g'))) IN (SELECT (conv_id, id) FROM art)),
m AS (SELECT * FROM e UNION SELECT conv_id, dst, src, CASE relation WHEN 'leads_to' THEN 'caused_by' ELSE 'leads_to' END FROM e WHERE relation <> 'references')"""


def _walk(steps: str, kind: str, hops: int, name: str = "w") -> str:
    return f""", st_{name} AS (SELECT DISTINCT conv_id, src AS a, dst AS b FROM ({steps})),
r_{name} AS (SELECT conv_id, id AS start, id AS node, 0 AS hops, id AS path FROM art WHERE {kind}
  UNION ALL SELECT r.conv_id, start, b, hops + 1, path || '>' || b FROM r_{name} r JOIN st_{name} s ON s.conv_id = r.conv_id AND s.a = r.node WHERE hops < {hops} AND NOT contains(path, b)),
{name} AS (SELECT conv_id, start, node, hops, min(path) AS path FROM r_{name} WHERE hops > 0 GROUP BY conv_id, start, node, hops QUALIFY row_number() OVER (PARTITION BY conv_id, start, node ORDER BY hops) = 1)"""


_BOTH = "SELECT conv_id, src, dst FROM e UNION SELECT conv_id, dst, src FROM e"
_FEATURES = f"""WITH {Q.ART}, f0 AS (SELECT conv_id, id, turn_id, obj_type, content, concat_ws(' ', coalesce(content, ''), coalesce(quote, '')) AS txt FROM art),
f AS (SELECT conv_id, id, turn_id, obj_type, {_hash('txt')} AS v, {Q.keywords('txt')} AS ka, {Q.keywords('content')} AS kc FROM f0),
p AS (SELECT n.conv_id, n.id AS src, o.id AS dst, o.turn_id AS ot, round(list_cosine_similarity(n.v, o.v), 6) AS sim, list_has_any(n.ka, o.kc) AS ov FROM f n JOIN f o ON n.conv_id = o.conv_id AND o.turn_id < n.turn_id @cond@)"""


def _sql_rule(cond: str, where: str, relation: str, qualify: str = "") -> str:
    return _FEATURES.replace("@cond@", cond) + f" SELECT src, dst, '{relation}' AS relation FROM p WHERE {where} {qualify}"


_SEEDS = _EDGES + "," + _base().strip().removeprefix("WITH ").replace(f"{Q.ART}, ", "", 1) + f",{_LEX}, top AS ({_best('lex', 5, 'conv_id, q_id, rank, doc_id, score')})"


def _visits(hops: int) -> str:
    """A breadth-first visit, a layer at a time."""
    out = """, nb AS (SELECT conv_id, id, neighbour, min(o) AS ord FROM (SELECT conv_id, src AS id, dst AS neighbour, list_position(['references', 'leads_to', 'caused_by'], relation) * 2 AS o FROM m
  UNION ALL SELECT conv_id, dst, src, list_position(['references', 'leads_to', 'caused_by'], relation) * 2 + 1 FROM m) GROUP BY ALL),
l0 AS (SELECT conv_id, q_id, doc_id, 0 AS hops, score, rank AS pos FROM top)"""
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT (conv_id, q_id, doc_id) FROM l{k}" for k in range(h))
        out += f""", c{h} AS (SELECT l.conv_id, q_id, neighbour AS doc_id, pos AS p, ord, score FROM l{h - 1} l JOIN nb ON nb.conv_id = l.conv_id AND nb.id = l.doc_id WHERE (l.conv_id, q_id, neighbour) NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY l.conv_id, q_id, neighbour ORDER BY pos, ord) = 1),
l{h} AS (SELECT conv_id, q_id, doc_id, {h} AS hops, score * {0.8**h!r}::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY p, ord, doc_id) AS pos FROM c{h})"""
    return out + " UNION ALL ".join(f" SELECT q_id, doc_id, hops, round(score, 6) AS score FROM l{h}" for h in range(1, hops + 1))


_FIT = "CASE WHEN ov THEN sim >= 0.3 ELSE sim >= 0.45 END"
QUERIES = {f.__name__: f for f in (g2_mirrored_edges, g5_neighbours, g6_khop, g7_shortest_paths, g8_roots, g9_leaves, g10_topological_order, g11_graph_size, g20_causal_chains, g21_cooccurrence, g22_top_decisions, g24_links, q5_graph_expansion, q15_multihop_expansion)}
QUERIES |= {f"g{11 + n}_relation_rule_{n}": _rule(n) for n in range(1, 8)}
ORACLE = {
    "g2_mirrored_edges": _EDGES + " SELECT conv_id, src, dst, relation FROM m",
    "g5_neighbours": _EDGES + " SELECT id, neighbour, min(o) AS ord FROM (SELECT conv_id, src AS id, dst AS neighbour, list_position(['references', 'leads_to', 'caused_by'], relation) * 2 AS o FROM e UNION ALL SELECT conv_id, dst, src, list_position(['references', 'leads_to', 'caused_by'], relation) * 2 + 1 FROM e) GROUP BY conv_id, id, neighbour",
    "g6_khop": _EDGES + _walk(_BOTH, "true", 2) + " SELECT start, node, hops FROM w WHERE start <> node",
    "g8_roots": _EDGES + " SELECT id FROM art WHERE (conv_id, id) NOT IN (SELECT (conv_id, dst) FROM e WHERE relation = 'leads_to')",
    "g9_leaves": _EDGES + " SELECT id FROM art WHERE (conv_id, id) NOT IN (SELECT (conv_id, src) FROM m)",
    "g10_topological_order": _EDGES + ", d AS (SELECT DISTINCT conv_id, src, dst FROM m WHERE relation = 'leads_to'), t AS (SELECT conv_id, id, 0 AS level FROM art UNION SELECT d.conv_id, d.dst, level + 1 FROM t JOIN d ON d.conv_id = t.conv_id AND d.src = t.id WHERE level < 200), x AS (SELECT conv_id, id, max(level) AS level FROM t GROUP BY 1, 2) SELECT id, level FROM x WHERE conv_id NOT IN (SELECT conv_id FROM x WHERE level >= 200)",
    "g11_graph_size": _EDGES + " SELECT conv_id, count(*) AS n_nodes, coalesce(any_value(n), 0) AS n_edges FROM art LEFT JOIN (SELECT conv_id, count(*) AS n FROM m GROUP BY 1) USING (conv_id) GROUP BY 1",
    "g20_causal_chains": _EDGES + _walk("SELECT conv_id, src, dst FROM m WHERE relation = 'caused_by'", "obj_type = 'decision'", 3) + " SELECT start, count(*) + 1 AS length, string_agg(node, ',' ORDER BY hops, node) AS chain FROM w GROUP BY conv_id, start",
    "g21_cooccurrence": f"WITH {Q.ENTRIES}, k AS (SELECT DISTINCT conv_id, entry_id, lower(trim(x)) AS x FROM (SELECT conv_id, entry_id, unnest(keywords) AS x FROM ent) WHERE x IS NOT NULL AND trim(x) <> '') SELECT a.x AS a, b.x AS b, count(*) AS n FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.entry_id = b.entry_id AND a.x < b.x GROUP BY 1, 2",
    "g22_top_decisions": _EDGES + ", g AS (SELECT conv_id, id, count(*) AS degree FROM (SELECT conv_id, src AS id FROM e UNION ALL SELECT conv_id, dst FROM e) GROUP BY 1, 2), d AS (SELECT art.conv_id, art.id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY art.conv_id ORDER BY coalesce(degree, 0) DESC, art.id) AS rank FROM art LEFT JOIN g ON g.conv_id = art.conv_id AND g.id = art.id WHERE obj_type = 'decision') SELECT * FROM d WHERE rank <= 3",
    "g24_links": _EDGES + " SELECT CASE relation WHEN 'caused_by' THEN dst ELSE src END AS source, CASE relation WHEN 'caused_by' THEN src ELSE dst END AS target, relation FROM e",
    "q5_graph_expansion": _SEEDS + _visits(3),
    "q15_multihop_expansion": _SEEDS + _walk(_BOTH, "true", 2) + " SELECT t.q_id, node AS doc_id, hops, round(score * 0.8 ** hops, 6) AS score FROM top t JOIN w ON w.conv_id = t.conv_id AND w.start = t.doc_id WHERE (t.q_id, node) NOT IN (SELECT (q_id, doc_id) FROM top) AND node <> start QUALIFY row_number() OVER (PARTITION BY t.conv_id, t.q_id, node ORDER BY rank) = 1",
    "g12_relation_rule_1": _sql_rule("", "sim >= 0.5 OR (ov AND sim >= 0.3)", "references"),
    "g13_relation_rule_2": _sql_rule("AND o.turn_id >= n.turn_id - 5 AND n.obj_type = 'todo' AND o.obj_type = 'decision'", _FIT, "caused_by", "QUALIFY row_number() OVER (PARTITION BY conv_id, src ORDER BY sim DESC, ot, dst) = 1"),
    "g14_relation_rule_3": _sql_rule("AND o.turn_id >= n.turn_id - 3 AND n.obj_type = 'insight' AND o.obj_type IN ('key_fact', 'decision')", _FIT, "caused_by"),
    "g15_relation_rule_4": _sql_rule("AND o.turn_id >= n.turn_id - 2 AND n.obj_type = 'decision' AND o.obj_type IN ('key_fact', 'reminder')", "ov", "caused_by", "QUALIFY row_number() OVER (PARTITION BY conv_id, src ORDER BY ot DESC, dst) <= 2"),
    "g16_relation_rule_5": _sql_rule("AND n.obj_type = 'event' AND o.obj_type = 'person_attribute'", "sim >= 0.5 OR ov", "references"),
    "g17_relation_rule_6": _sql_rule("AND n.obj_type = 'relationship' AND o.obj_type = 'person_attribute'", "sim >= 0.5 OR ov", "references"),
    "g18_relation_rule_7": _sql_rule("AND o.turn_id >= n.turn_id - 10 AND n.obj_type = 'decision' AND o.obj_type = 'event'", "ov", "caused_by"),
}
