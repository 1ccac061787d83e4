"""Queries of sources and sinks, streams, learning and the places for models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import vectors as V
from memloom.operators import backends as B
from memloom.operators import graph as G
from memloom.operators import learning as L
from memloom.operators import retrieval as R
from memloom.plans import metrics as MQ
from memloom.plans import sqltext as Q
from memloom.plans.extractions import _RULES
from memloom.plans.graphs import _EDGES, _FIT
from memloom.plans.graphs import _FEATURES as _PAIRS
from memloom.plans.retrieval import _top, docs, questions
from memloom.plans.texts import artifacts, entries, facts
from memloom.session import shared_dir
from memloom.sources import canvas_json as J
from memloom.sources.tables import table
from memloom.streaming import incremental as I


def s1_saved_and_loaded(spark, folder):
    import uuid

    path = f"{shared_dir(spark)}/memloom/canvas-{uuid.uuid4().hex}"
    J.save(artifacts(spark, folder).select("conv_id", "id", "obj_type", "content"), path)
    return J.load(spark, path).select("conv_id", "id", "obj_type", "content")


def s5_json_round_trip(spark, folder):
    return J.from_rows(J.to_rows(artifacts(spark, folder))).select("id", "obj_type", "content", "context", "quote", F.col("source").alias("src"), "turn_id", "confidence", "event_time_raw", *[F.array_join(c, ",", "").alias(c) for c in ("references", "leads_to", "caused_by")])


def s6_edge_map(spark, folder):
    m = J.edge_map(G.edges(artifacts(spark, folder)))
    return J.edges_of(m)


def s7_config_keys(spark, folder):
    return table(spark, folder, "sessions").select("agent_name", "compact_every").distinct().select("agent_name", "compact_every", J.config_key(F.col("agent_name"), F.col("compact_every")).alias("cache_key"))


def s12_export(spark, folder):
    return J.export(facts(spark, folder)).select("conv_id", "n_facts", "json")


def s16_all_facts(spark, folder):
    a = artifacts(spark, folder).where("obj_type = 'key_fact'").select(F.lit("artifacts").alias("origin"), F.col("id").alias("key"), "content")
    return facts(spark, folder).select(F.lit("facts").alias("origin"), F.col("fact_id").alias("key"), "content").unionByName(a)


def w10_session_registry(spark, folder):
    return I.run_to_table(I.conversation_state(I.source(spark, folder, "archive_entries")), "complete", "registry")


def w11_event_windows(spark, folder):
    counted = I.event_counts(I.source(spark, folder, "events"), "1 day", "3650 days")
    return I.run_to_table(counted, "complete", "events").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def x1_extracted_stream(spark, folder):
    return I.run_to_table(I.extracted_stream(I.source(spark, folder, "archive_entries")), "append", "extract").dropDuplicates(["entry_id", "obj_type"]).select("entry_id", "obj_type", "content", "src")


def g19_auto_link(spark, folder):
    f = G.featured(artifacts(spark, folder))
    every = G.relation_rule(f, 2)
    for rule in (3, 4, 7):
        every = every.unionByName(G.relation_rule(f, rule))
    return G.mirrored(every.distinct()).select("src", "dst", "relation")


def q7_filtered(spark, folder):
    return B.judged(_top(spark, folder, 20), B.shared_word_rating, 5, 0.1).select("q_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def q31_feedback_round(spark, folder):
    d, q = docs(spark, folder), questions(spark, folder)
    first = R.retrieve(d, q, 10, "bm25")
    best = first.where("rank = 1").join(d.select("conv_id", "doc_id", F.col("tokens").alias("more")), ["conv_id", "doc_id"]).select("conv_id", "q_id", "more")
    again = q.join(best, ["conv_id", "q_id"]).withColumn("tokens", F.concat("tokens", "more"))
    second = R.retrieve(d, again, 10, "bm25").withColumn("rank", F.col("rank") + 10)
    both = first.unionByName(second).groupBy("conv_id", "q_id", "doc_id").agg(F.min("rank").alias("ord"))
    w = Window.partitionBy("conv_id", "q_id").orderBy("ord", "doc_id")
    return both.withColumn("pos", F.row_number().over(w)).where("pos <= 15").select("q_id", "pos", "doc_id")


def e3_backend_vectors(spark, folder):
    return B.embed(facts(spark, folder), "fact_id", "content", lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]).select("key", F.element_at("vec", 1).alias("a"), F.element_at("vec", 2).alias("b"))


_FEATURES = ["n_chars", "n_words", "digits", "names", "is_decision", "is_requirement", "is_constraint", "is_preference", "is_easy", "is_medium", "is_hard", "is_adversarial"]


def v8_loss_model(spark, folder):
    rows = MQ.m1_loss_features(spark, folder).na.fill(0)
    return L.fit_loss(rows, _FEATURES, "was_lost").transform(rows).select("fact_id", F.round(vector_to_array("probability")[1], 4).alias("p_lost"))


def m3_vulnerability_model(spark, folder):
    rows = MQ.m1_loss_features(spark, folder).na.fill(0).withColumn("label", F.col("was_lost").cast("double"))
    return L.evaluation(L.fit_vulnerability(rows, _FEATURES, "label").transform(rows), "label", "prediction")


def v9_clusters(spark, folder):
    e = entries(spark, folder).where(V.usable(F.col("embedding"), 128))
    return L.clusters(e.select("entry_id", "embedding"), "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


def v10_learned_importance(spark, folder):
    a = artifacts(spark, folder)
    rates = a.groupBy("obj_type").agg(F.avg((F.col("confidence") >= 0.7).cast("double")).alias("rate"))
    return L.learned_importance(a, rates)


_AUTO = f""", q AS (SELECT p.*, n.obj_type AS nt, n.turn_id AS t, o.obj_type AS pt FROM p JOIN f n ON n.id = src JOIN f o ON o.id = dst),
r AS (SELECT conv_id, src, dst FROM (SELECT * FROM q WHERE nt = 'todo' AND pt = 'decision' AND ot >= t - 5 AND ({_FIT}) QUALIFY row_number() OVER (PARTITION BY conv_id, src ORDER BY sim DESC, ot, dst) = 1)
 UNION SELECT conv_id, src, dst FROM q WHERE nt = 'insight' AND pt IN ('key_fact', 'decision') AND ot >= t - 3 AND ({_FIT})
 UNION SELECT conv_id, src, dst FROM (SELECT * FROM q WHERE nt = 'decision' AND pt IN ('key_fact', 'reminder') AND ot >= t - 2 AND ov QUALIFY row_number() OVER (PARTITION BY conv_id, src ORDER BY ot DESC, dst) <= 2)
 UNION SELECT conv_id, src, dst FROM q WHERE nt = 'decision' AND pt = 'event' AND ot >= t - 10 AND ov)
SELECT src, dst, 'caused_by' AS relation FROM r UNION SELECT dst, src, 'leads_to' FROM r"""
_W = "CASE obj_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.IMPORTANCE.items()) + " ELSE 0.5 END"
QUERIES = {f.__name__: f for f in (s1_saved_and_loaded, s5_json_round_trip, s6_edge_map, s7_config_keys, s12_export, s16_all_facts, w10_session_registry, w11_event_windows, x1_extracted_stream, g19_auto_link, q7_filtered, q31_feedback_round, e3_backend_vectors, v8_loss_model, m3_vulnerability_model, v9_clusters, v10_learned_importance)}
ORACLE = {
    "s1_saved_and_loaded": f"WITH {Q.ART} SELECT conv_id, id, obj_type, content FROM art",
    "s5_json_round_trip": f"WITH {Q.ART} SELECT id, obj_type, coalesce(content, '') AS content, coalesce(context, '') AS context, coalesce(quote, '') AS quote, coalesce(src, '') AS src, turn_id, coalesce(confidence, 1.0) AS confidence, event_time_raw, " + ", ".join(f"coalesce(array_to_string(list_transform({c}, lambda x: coalesce(x, '')), ','), '') AS {n}" for c, n in (("references_ids", '"references"'), ("leads_to", "leads_to"), ("caused_by", "caused_by"))) + " FROM art",
    "s6_edge_map": _EDGES + " SELECT conv_id, src, dst, relation FROM e",
    "s7_config_keys": "SELECT DISTINCT agent_name, compact_every, substr(md5('{' || concat_ws(',', '\"agent_name\":\"' || agent_name || '\"', '\"compact_every\":' || compact_every) || '}'), 1, 8) AS cache_key FROM sessions",
    "s12_export": f"WITH {Q.FACTS} SELECT conv_id, count(*) AS n_facts, '[' || string_agg('{{' || concat_ws(',', '\"turn_id\":' || turn_id, '\"fact_id\":' || to_json(fact_id), '\"content\":' || to_json(content), '\"ground_truth\":' || to_json(ground_truth)) || '}}', ',' ORDER BY turn_id NULLS FIRST, fact_id) || ']' AS json FROM fct GROUP BY 1",
    "x1_extracted_stream": f"WITH {Q.ENTRIES} {_RULES}",
    "g19_auto_link": _PAIRS.replace("@cond@", "AND o.turn_id >= n.turn_id - 10") + _AUTO,
    "s16_all_facts": f"WITH {Q.ART}, {Q.FACTS} SELECT 'facts' AS origin, fact_id AS key, content FROM fct UNION ALL SELECT 'artifacts', id, content FROM art WHERE obj_type = 'key_fact'",
    "w10_session_registry": "SELECT conv_id, count(*) AS n_turns, max(turn_id) AS last_turn FROM archive_entries GROUP BY 1",
    "w11_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "v10_learned_importance": f"WITH {Q.ART}, r AS (SELECT obj_type, avg((confidence >= 0.7)::INT) AS rate FROM art GROUP BY 1) SELECT id, round(least(1.0, (0.5 * ({_W}) + 0.5 * coalesce(rate, 0.5)) * coalesce(confidence, 0.0) * CASE WHEN coalesce(regexp_matches(content, '(?i)\\b(must|require|required|critical|important)\\b'), false) THEN 1.2 ELSE 1.0 END)::DOUBLE, 6) AS importance FROM art LEFT JOIN r USING (obj_type)",
    "e3_backend_vectors": f"WITH {Q.FACTS} SELECT fact_id AS key, CASE WHEN trim(content) <> '' THEN length(content)::FLOAT END AS a, CASE WHEN trim(content) <> '' THEN (list_sum(list_transform(regexp_extract_all(content, '(?s).'), lambda c: unicode(c)))::BIGINT % 97)::FLOAT END AS b FROM fct",
}
