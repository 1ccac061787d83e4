"""Queries of the filters, text functions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import scoring as C
from memloom.functions import text as X
from memloom.plans import sqltext as Q
from memloom.sources.tables import once, table


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "artifacts"), "id", order=("loaded_at",))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "facts"), "fact_id", order=("loaded_at",))


def results(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "fact_results"), "result_id", order=("asked_at",))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "archive_entries"), "entry_id", order=("created_at",))


def _sorted(c):
    return F.array_join(F.array_sort(c), " ")


def f1_type_filter(spark, folder):
    return artifacts(spark, folder).where("obj_type = 'decision'").select("id", "conv_id", "turn_id", "content")


def f2_list_objects(spark, folder):
    w = Window.partitionBy("conv_id").orderBy("turn_id", "id")
    return artifacts(spark, folder).where("obj_type = 'event'").select("conv_id", "id", F.row_number().over(w).alias("pos"))


def f4_get(spark, folder):
    a = artifacts(spark, folder)
    return a.join(table(spark, folder, "removals").where("tab = 'artifacts'").select(F.col("object_id").alias("id")).distinct(), "id", "left_semi").select("id", "obj_type", "content")


def f5_bm25_tokens(spark, folder):
    t = X.bm25_tokens(F.col("content"))
    return artifacts(spark, folder).select("id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n_tokens"))


def f6_keyword_sets(spark, folder):
    return artifacts(spark, folder).select("id", _sorted(X.keyword_set(F.concat_ws(" ", "content", "quote"))).alias("keywords"))


def f7_resolver_keywords(spark, folder):
    return facts(spark, folder).select("fact_id", F.array_join(X.resolver_keywords(F.col("test_question")), " ").alias("keywords"))


def f8_normalised(spark, folder):
    return results(spark, folder).select("result_id", X.normalised(F.col("answer")).alias("norm"))


def f10_overlap_keywords(spark, folder):
    return results(spark, folder).select("result_id", _sorted(X.overlap_keywords(F.col("ground_truth"))).alias("keywords"))


def f11_text_features(spark, folder):
    c = F.col("content")
    return artifacts(spark, folder).select("id", X.has_digits(c).alias("digits"), *[X.has_names(c, v).alias(f"names_v{v}") for v in (1, 2, 3)])


def f15_trigger_counts(spark, folder):
    return artifacts(spark, folder).select("id", *[X.count_phrases(F.col("content"), p).alias(f"n_{k}") for k, (_, p) in S.SCORE_TRIGGERS.items()])


def f16_questions(spark, folder):
    q = F.col("test_question")
    return facts(spark, folder).select("fact_id", X.is_temporal(q).alias("temporal"), X.adaptive_k(q, 10).alias("k"), X.complexity(q).alias("complexity"))


def f19_sizes(spark, folder):
    return artifacts(spark, folder).select("id", X.token_estimate(F.col("content")).alias("tokens"), X.shortened(F.col("quote"), 100).alias("short_quote"), F.substring("content", 1, 200).alias("head"), X.entity_name(F.col("obj_type")).alias("name"))


def f23_meta_json(spark, folder):
    r = once(table(spark, folder, "agent_responses"), "response_id", order=("created_at",))
    meta = F.from_json(X.fenced_json(F.col("meta_json")), "hops int, top_k int, strategy string")
    return r.select("response_id", meta.alias("m")).select("response_id", "m.hops", "m.top_k", "m.strategy")


def c6_rule_scores(spark, folder):
    k, c, x = F.col("obj_type"), F.col("content"), F.col("context")
    return artifacts(spark, folder).select("id", F.round(C.trigger_part(k, c), 6).alias("trigger_part"), F.round(C.length_part(c), 6).alias("length_part"), F.round(C.type_part(k, c), 6).alias("type_part"), F.round(C.rule_score(k, c, x), 6).alias("score"), F.round(C.blended(C.rule_score(k, c, x), F.col("confidence")), 6).alias("blended"))


def c2_inferred_types(spark, folder):
    return facts(spark, folder).select("fact_id", C.inferred_type(F.col("test_question")).alias("inferred"))


_TRIG = "CASE obj_type " + " ".join(f"WHEN '{k}' THEN CASE WHEN {Q.count_of('content', p)} = 0 THEN -0.2 ELSE least({w}, {w} * {Q.count_of('content', p)} / 2) END" for k, (w, p) in S.SCORE_TRIGGERS.items()) + " ELSE 0.0 END"
_LEN = "CASE WHEN coalesce(length(content), 0) < 10 THEN -0.3 WHEN length(content) <= 500 THEN 0.1 ELSE -least(0.3, (length(content) - 500) / 1000.0) END"
_TYPE = f"CASE WHEN obj_type = 'key_fact' THEN CASE WHEN coalesce(regexp_matches(content, '[0-9]'), false) OR coalesce(regexp_matches(content, '[A-Z][a-z]+ [A-Z][a-z]+'), false) THEN 0.1 ELSE -0.1 END WHEN obj_type = 'todo' AND {Q.any_of('content', S.TODO_VERBS)} THEN 0.1 WHEN obj_type = 'decision' AND {Q.any_of('content', ['will', 'going to', 'decided'])} THEN 0.1 ELSE 0.0 END"
_SCORE = f"greatest(0.0, least(1.0, 0.5::DOUBLE + {_TRIG} + {_LEN} + CASE WHEN trim(coalesce(context, '')) <> '' THEN 0.1 ELSE 0.0 END + {_TYPE}))"
_NAME = "list_bool_or(list_transform(w, lambda x, i: i > 1 AND regexp_matches(x, '^\\p{{Lu}}'){more}))"
_COMPLEX = " OR ".join(f"coalesce(regexp_matches(lower(test_question), '{p}'), false)" for p in [X.phrase_pattern(S.COMPLEX_PHRASES), *[rf"\b{a}.*{b}\b" for a, b in S.COMPLEX_PAIRS]])


def _names(more: str) -> str:
    return "coalesce(" + _NAME.format(more=more) + ", false)"


QUERIES = {f.__name__: f for f in (f1_type_filter, f2_list_objects, f4_get, f5_bm25_tokens, f6_keyword_sets, f7_resolver_keywords, f8_normalised, f10_overlap_keywords, f11_text_features, f15_trigger_counts, f16_questions, f19_sizes, f23_meta_json, c6_rule_scores, c2_inferred_types)}
ORACLE = {
    "f1_type_filter": f"WITH {Q.ART} SELECT id, conv_id, turn_id, content FROM art WHERE obj_type = 'decision'",
    "f2_list_objects": f"WITH {Q.ART} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, id) AS pos FROM art WHERE obj_type = 'event'",
    "f4_get": f"WITH {Q.ART} SELECT id, obj_type, content FROM art WHERE id IN (SELECT object_id FROM removals WHERE tab = 'artifacts')",
    "f5_bm25_tokens": f"WITH {Q.ART} SELECT id, array_to_string(t, ' ') AS tokens, len(t) AS n_tokens FROM (SELECT id, {Q.bm25('content')} AS t FROM art)",
    "f6_keyword_sets": f"WITH {Q.ART} SELECT id, {Q.joined(Q.keywords('concat_ws(chr(32), content, quote)'))} AS keywords FROM art",
    "f7_resolver_keywords": f"WITH {Q.FACTS} SELECT fact_id, array_to_string({Q.plain('test_question', S.RESOLVER_STOPWORDS)}, ' ') AS keywords FROM fct",
    "f8_normalised": f"WITH {Q.RESULTS} SELECT result_id, {Q.normalised('answer')} AS norm FROM res",
    "f10_overlap_keywords": f"WITH {Q.RESULTS} SELECT result_id, array_to_string(list_sort(coalesce(CASE WHEN regexp_matches(ground_truth, '[一-鿿]') THEN regexp_extract_all(regexp_replace(ground_truth, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), '.') ELSE list_filter(regexp_split_to_array(lower(ground_truth), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({Q.quoted(S.OVERLAP_STOPWORDS)})) END, [])), ' ') AS keywords FROM res",
    "f11_text_features": f"WITH {Q.ART}, w AS (SELECT id, content, {Q.words('content')} AS w FROM art) SELECT id, coalesce(regexp_matches(content, '[0-9]'), false) AS digits, {_names('')} AS names_v1, {_names(' AND x <> upper(x)')} AS names_v2, {_names(' AND x <> upper(x) AND NOT ends_with(w[i - 1], chr(46))')} AS names_v3 FROM w",
    "f15_trigger_counts": f"WITH {Q.ART} SELECT id, " + ", ".join(f"{Q.count_of('content', p)} AS n_{k}" for k, (_, p) in S.SCORE_TRIGGERS.items()) + " FROM art",
    "f16_questions": f"WITH {Q.FACTS} SELECT fact_id, {Q.any_of('test_question', S.TEMPORAL_WORDS)} AS temporal, CASE WHEN {Q.any_of('test_question', S.MULTIHOP_WORDS)} THEN 15 WHEN {Q.any_of('test_question', S.WIDER_WORDS)} THEN 12 ELSE 10 END AS k, CASE WHEN {_COMPLEX} OR len({Q.words('test_question')}) > 15 THEN 'complex' ELSE 'simple' END AS complexity FROM fct",
    "f19_sizes": f"WITH {Q.ART} SELECT id, coalesce(length(content), 0) // 4 AS tokens, CASE WHEN length(quote) > 100 THEN substr(quote, 1, 100) || '...' ELSE quote END AS short_quote, substr(content, 1, 200) AS head, lower(trim(obj_type)) AS name FROM art",
    "f23_meta_json": "WITH r AS (SELECT * FROM agent_responses QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY created_at) = 1), j AS (SELECT response_id, CASE WHEN json_valid(meta_json) THEN meta_json END AS m FROM r) SELECT response_id, TRY_CAST(m->>'$.hops' AS INT) AS hops, TRY_CAST(m->>'$.top_k' AS INT) AS top_k, m->>'$.strategy' AS strategy FROM j",
    "c6_rule_scores": f"WITH {Q.ART} SELECT id, round(({_TRIG})::DOUBLE, 6) AS trigger_part, round(({_LEN})::DOUBLE, 6) AS length_part, round(({_TYPE})::DOUBLE, 6) AS type_part, round(({_SCORE})::DOUBLE, 6) AS score, round(coalesce(0.3 * {_SCORE} + 0.7 * confidence, {_SCORE})::DOUBLE, 6) AS blended FROM art",
    "c2_inferred_types": f"WITH {Q.FACTS} SELECT fact_id, CASE " + " ".join(f"WHEN {Q.any_of('test_question', h)} THEN '{k}'" for k, h in S.TYPE_HINTS.items()) + " END AS inferred FROM fct",
}
