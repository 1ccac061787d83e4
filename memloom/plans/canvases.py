"""Queries of changing, saving and loading a canvas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memloom.functions import vectors as V
from memloom.operators import canvas as C
from memloom.operators import extraction as E
from memloom.operators import graph as G
from memloom.operators import selection as P
from memloom.plans import selections as PQ
from memloom.plans import sqltext as Q
from memloom.plans.extractions import _RULES
from memloom.plans.graphs import _EDGES
from memloom.plans.retrieval import _hash
from memloom.plans.texts import artifacts, entries, facts
from memloom.session import shared_dir
from memloom.sources import canvas_json as J
from memloom.sources.tables import once, table
from memloom.streaming import incremental as I


def g1_added_nodes(spark, folder):
    """The canvas after every fact is added by hand, with a vector of the content alone; facts that are there already stay as they are."""
    nodes = artifacts(spark, folder).select("conv_id", "id", F.col("obj_type").alias("kind"), "content")
    more = facts(spark, folder).select("conv_id", F.col("fact_id").alias("id"), F.lit("key_fact").alias("kind"), "content")
    v = V.unit(V.hash_vector(F.col("content")))
    return C.add(nodes, more.unionByName(more)).select("id", "kind", *[F.round(v[i], 6).alias(f"v{i}") for i in range(2)])


def _requests(spark, folder):
    r = once(table(spark, folder, "fact_relations"), "rel_id", order=("loaded_at",))
    clean = F.lower(F.regexp_replace("target_id", r"(?U)^\s+|\s+$", ""))
    return r.select("conv_id", "rel_id", F.col("source_id").alias("src"), clean.alias("dst"), F.col("relation_type").alias("relation"))


def _fact_nodes(spark, folder):
    return facts(spark, folder).select("conv_id", F.col("fact_id").alias("id"), "turn_id")


def g3_link_results(spark, folder):
    return C.link(_fact_nodes(spark, folder), _requests(spark, folder)).select("rel_id", "linked")


def g3_linked_rows(spark, folder):
    nodes = _fact_nodes(spark, folder)
    rows = C.with_arrays(nodes, C.linked_edges(C.link(nodes, _requests(spark, folder))))
    return rows.select("id", *[F.array_join(c, ",").alias(c) for c in C.ARRAYS.values()])


def g4_removed_nodes(spark, folder):
    """For each standing removal whether the object was on the canvas."""
    gone = C.standing(table(spark, folder, "removals"), "artifacts")
    there = artifacts(spark, folder).select("id", F.lit(True).alias("there"))
    return gone.join(there, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("removed"))


def g4_remaining_edges(spark, folder):
    gone = C.standing(table(spark, folder, "removals"), "artifacts")
    return C.remove_edges(G.mirrored(G.edges(artifacts(spark, folder))), gone).select("src", "dst", "relation")


def g23_graph_statistics(spark, folder):
    a = artifacts(spark, folder)
    by_type = a.groupBy(F.concat(F.lit("type:"), "obj_type").alias("measure")).agg(F.count("*").alias("n"))
    nodes = a.agg(F.lit("nodes").alias("measure"), F.count("*").alias("n"))
    edges = G.mirrored(G.edges(a)).agg(F.lit("edges").alias("measure"), F.count("*").alias("n"))
    return by_type.unionByName(nodes).unionByName(edges)


def i6_sizes(spark, folder):
    return C.sizes(artifacts(spark, folder))


def i6_cleared(spark, folder):
    """Sizes after the conversations of one agent are cleared."""
    dropped = table(spark, folder, "sessions").where("agent_name = 'native'").select("conv_id")
    return C.sizes(C.clear(artifacts(spark, folder), dropped))


def f3_by_type(spark, folder):
    """Of an extraction's rows those of one type."""
    return E.rule_artifacts(entries(spark, folder)).where("obj_type = 'event'").select("entry_id", "content")


def v6_chain_mode(spark, folder):
    """Edges that are left when everything was added and linked, and then all but the selected rows were deleted."""
    a = artifacts(spark, folder)
    chosen = P.prioritised(P.scored(a)).select("id")
    return C.remove_edges(G.mirrored(G.edges(a)), a.select("id").join(chosen, "id", "left_anti")).select("src", "dst", "relation")


def s2_loaded_state(spark, folder):
    """A saved canvas read back, with its edges and, as an older file, without: then its nodes have none."""
    a, base = artifacts(spark, folder), f"{shared_dir(spark)}/memloom/canvas-{uuid.uuid4().hex}"
    J.save_state(a, None, f"{base}/old")
    nodes, _ = J.load_state(spark, f"{base}/old")
    J.save_state(nodes, G.edges(nodes), f"{base}/new")
    out = None
    for name in ("new", "old"):
        nodes, edges = J.load_state(spark, f"{base}/{name}")
        n = C.sizes(nodes).join(edges.groupBy("conv_id").agg(F.count("*").alias("n_edges")), "conv_id", "left")
        row = n.select(F.lit(name).alias("saved"), "conv_id", F.col("turn_count").alias("turn_counter"), "size", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
        out = row if out is None else out.unionByName(row)
    return out


def s3_upserted(spark, folder):
    """The latest delivery of every fact, kept up to date by a stream that saves after each batch."""
    path = f"{shared_dir(spark)}/memloom/upsert-{uuid.uuid4().hex}"
    q = I.source(spark, folder, "facts").writeStream.foreachBatch(I.upsert(f"{path}/rows", ["fact_id"], "loaded_at")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return I.latest(spark, f"{path}/rows", ["fact_id"], "loaded_at").select("fact_id", "fact_type", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


def s4_saved_states(spark, folder):
    """Whether a state is there, before and after it is saved."""
    path = f"{shared_dir(spark)}/memloom/canvas-{uuid.uuid4().hex}"
    before = J.has_state(spark, path)
    J.save(artifacts(spark, folder).select("conv_id", "id"), path)
    return spark.createDataFrame([("before", before), ("after", J.has_state(spark, path))], "moment string, present boolean")


_REQ = f"{Q.FACTS}, req AS (SELECT conv_id, rel_id, source_id AS src, lower(regexp_replace(target_id, '^\\s+|\\s+$', '', 'g')) AS dst, relation_type AS relation FROM fact_relations QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at) = 1), res AS (SELECT req.*, coalesce(relation IN ('references', 'leads_to', 'caused_by'), false) AND a.fact_id IS NOT NULL AND b.fact_id IS NOT NULL AS linked FROM req LEFT JOIN fct a ON a.conv_id = req.conv_id AND a.fact_id = src LEFT JOIN fct b ON b.conv_id = req.conv_id AND b.fact_id = dst)"
_GONE = ", gone AS (SELECT DISTINCT object_id AS id FROM removals WHERE tab = 'artifacts' AND restored_at IS NULL AND object_id IS NOT NULL)"
_ADD_V = "round(v[{k}] / sqrt(list_dot_product(v, v)), 6)"
QUERIES = {f.__name__: f for f in (g1_added_nodes, g3_link_results, g3_linked_rows, g4_removed_nodes, g4_remaining_edges, g23_graph_statistics, i6_sizes, i6_cleared, f3_by_type, v6_chain_mode, s2_loaded_state, s3_upserted, s4_saved_states)}
ORACLE = {
    "g1_added_nodes": f"WITH {Q.ART}, {Q.FACTS}, n AS (SELECT id, obj_type AS kind, content FROM art UNION ALL SELECT fact_id, 'key_fact', content FROM fct WHERE (conv_id, fact_id) NOT IN (SELECT (conv_id, id) FROM art)), h AS (SELECT id, kind, {_hash("coalesce(content, '')")} AS v FROM n) SELECT id, kind, {_ADD_V.format(k=1)} AS v0, {_ADD_V.format(k=2)} AS v1 FROM h",
    "g3_link_results": f"WITH {_REQ} SELECT rel_id, linked FROM res",
    "g3_linked_rows": f"WITH {_REQ}, e AS (SELECT conv_id, src, dst, relation FROM res WHERE linked UNION SELECT conv_id, dst, src, CASE relation WHEN 'leads_to' THEN 'caused_by' ELSE 'leads_to' END FROM res WHERE linked AND relation <> 'references') SELECT fct.fact_id AS id, " + ", ".join(f"coalesce(string_agg(dst, ',' ORDER BY dst) FILTER (WHERE relation = '{r}'), '') AS {c}" for r, c in C.ARRAYS.items()) + " FROM fct LEFT JOIN e ON e.conv_id = fct.conv_id AND e.src = fct.fact_id GROUP BY fct.conv_id, fct.fact_id",
    "g4_removed_nodes": f"WITH {Q.ART}{_GONE} SELECT id, id IN (SELECT id FROM art) AS removed FROM gone",
    "g4_remaining_edges": _EDGES + _GONE + " SELECT src, dst, relation FROM m WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)",
    "g23_graph_statistics": _EDGES + " SELECT 'type:' || obj_type AS measure, count(*) AS n FROM art GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM art UNION ALL SELECT 'edges', count(*) FROM m",
    "i6_sizes": f"WITH {Q.ART} SELECT conv_id, count(*) AS size, max(turn_id) AS turn_count FROM art GROUP BY 1",
    "i6_cleared": f"WITH {Q.ART} SELECT conv_id, count(*) AS size, max(turn_id) AS turn_count FROM art WHERE conv_id NOT IN (SELECT conv_id FROM sessions WHERE agent_name = 'native') GROUP BY 1",
    "f3_by_type": f"WITH {Q.ENTRIES}, x AS ({_RULES}) SELECT entry_id, content FROM x WHERE obj_type = 'event'",
    "v6_chain_mode": PQ._H.replace(f"WITH {Q.ART}", _EDGES) + ", c AS (SELECT id FROM s WHERE rank <= 10) SELECT src, dst, relation FROM m WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)",
    "s2_loaded_state": _EDGES + ", z AS (SELECT conv_id, max(turn_id) AS turn_counter, count(*) AS size FROM art GROUP BY 1), k AS (SELECT conv_id, count(*) AS n FROM e GROUP BY 1) SELECT 'new' AS saved, z.*, coalesce(n, 0) AS n_edges FROM z LEFT JOIN k USING (conv_id) UNION ALL SELECT 'old', z.*, 0 FROM z",
    "s3_upserted": "SELECT fact_id, arg_max(fact_type, loaded_at) AS fact_type, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS loaded FROM facts GROUP BY 1",
    "s4_saved_states": "SELECT * FROM (VALUES ('before', false), ('after', true)) t(moment, present)",
}
