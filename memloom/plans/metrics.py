"""Queries of answer scores and their aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import metrics as M
from memloom.plans import sqltext as Q
from memloom.schema import OVERLAP_STOPWORDS
from memloom.plans.texts import artifacts, facts, results


def _scored(spark, folder):
    s = M.token_f1(F.col("answer"), F.col("ground_truth"))
    exact = M.contained(F.col("answer"), F.col("ground_truth"))
    return results(spark, folder).select("*", *[F.round(c, 6).alias(k) for k, c in s.items()], exact.alias("contains")).withColumn("passed", F.col("contains") | (F.col("f1") >= 0.5))


def a5_fuzzy_scores(spark, folder):
    return results(spark, folder).select("result_id", M.fuzzy("answer", "ground_truth").alias("fuzzy"))


def a6_token_f1(spark, folder):
    return _scored(spark, folder).select("result_id", "precision", "recall", "f1", "contains", "passed")


def a9_keyword_coverage(spark, folder):
    k = X.words(F.col("ground_truth"))
    return results(spark, folder).select("result_id", F.round(M.keyword_coverage(F.col("answer"), k), 6).alias("coverage"))


def a10_overlap(spark, folder):
    return results(spark, folder).select("result_id", F.round(M.overlap(F.col("answer"), F.col("ground_truth")), 6).alias("overlap"))


def a11_rates(spark, folder):
    return M.rates(_scored(spark, folder), "passed", ["conv_id", "agent_name"])


def a12_macro_micro(spark, folder):
    return M.macro_and_micro(_scored(spark, folder), "passed", "fact_type")


def a16_cluster_performance(spark, folder):
    f = facts(spark, folder).select("fact_id", F.coalesce("difficulty", F.lit("none")).alias("cluster"))
    r = _scored(spark, folder).join(f, "fact_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit("unknown")))
    g = r.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("recall"), F.round(F.avg("fuzzy_score"), 6).alias("mean_fuzzy"))
    return g.withColumn("vulnerability", F.round(1 - F.col("recall"), 6)).withColumn("weight", F.round(1 + F.col("vulnerability"), 6))


def a22_diagnosis(spark, folder):
    r = _scored(spark, folder).where("not passed")
    return r.groupBy("agent_name", M.diagnosis(F.col("f1"), F.col("answer")).alias("cause")).agg(F.count("*").alias("n"))


def a23_regressions(spark, folder):
    s = _scored(spark, folder).groupBy("conv_id", "fact_id", "agent_name").agg(F.max("passed").alias("passed"))
    a = s.where("agent_name = 'native' and not passed").select("conv_id", "fact_id")
    b = s.where("agent_name = 'rag' and passed").select("conv_id", "fact_id")
    return a.join(b, ["conv_id", "fact_id"])


def a25_type_share(spark, folder):
    n = artifacts(spark, folder).groupBy("obj_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def a26_threshold_sweep(spark, folder):
    bars = spark.createDataFrame([("low", 0.3), ("default", 0.5), ("high", 0.7), ("very_high", 0.8)], "config string, bar double")
    r = _scored(spark, folder).select("agent_name", "f1").crossJoin(F.broadcast(bars))  # four rows
    return r.groupBy("config", "agent_name").agg(F.round(F.avg((F.col("f1") >= F.col("bar")).cast("double")), 6).alias("rate"))


def a28_case_split(spark, folder):
    return _scored(spark, folder).groupBy("fact_type", "passed").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), 4).alias("mean_latency"))


def a29_extraction_coverage(spark, folder):
    said = artifacts(spark, folder).select("conv_id", F.explode(X.bm25_tokens(F.concat_ws(" ", "content", "quote"))).alias("w")).distinct()
    want = facts(spark, folder).select("fact_id", "conv_id", F.explode_outer(F.array_distinct(X.bm25_tokens(F.col("ground_truth")))).alias("w"))
    share = want.join(said.withColumn("hit", F.lit(1)), ["conv_id", "w"], "left").groupBy("fact_id").agg(F.round(F.coalesce(F.sum("hit") / F.nullif(F.count("w"), F.lit(0)), F.lit(0.0)), 6).alias("share"))
    return share.withColumn("bucket", F.when(F.col("share") >= 0.8, "covered").when(F.col("share") >= 0.3, "partial").otherwise("missing"))


def a30_version_diff(spark, folder):
    s = _scored(spark, folder).where("not passed")
    a = s.where("agent_name = 'native'").select("fact_id").distinct()
    b = s.where("agent_name = 'summarization'").select("fact_id").distinct()
    return a.subtract(b).withColumn("side", F.lit("fixed")).unionByName(b.subtract(a).withColumn("side", F.lit("new")))


def m1_loss_features(spark, folder):
    f, c = facts(spark, folder), F.col("content")
    kinds = [F.when(F.col("fact_type") == k, 1).otherwise(0).alias(f"is_{k}") for k in ("decision", "requirement", "constraint", "preference")]
    levels = [F.when(F.col("difficulty") == k, 1).otherwise(0).alias(f"is_{k}") for k in ("easy", "medium", "hard", "adversarial")]
    return f.select("fact_id", (F.col("turn_id") < 35).cast("int").alias("was_lost"), F.length(c).alias("n_chars"), F.size(X.words(c)).alias("n_words"), X.has_digits(c).cast("int").alias("digits"), X.has_names(c, 3).cast("int").alias("names"), *kinds, *levels)


_A, _T = f"({Q.words(Q.normalised('answer'))})", f"({Q.words(Q.normalised('ground_truth'))})"
_SC = f"""WITH {Q.RESULTS}, n AS (SELECT *, {Q.normalised('answer')} AS na, {Q.normalised('ground_truth')} AS nt FROM res),
w AS (SELECT *, {Q.words('na')} AS a, {Q.words('nt')} AS t FROM n), i AS (SELECT *, len(list_intersect(a, t))::DOUBLE AS sh FROM w),
pr AS (SELECT *, CASE WHEN len(a) > 0 THEN sh / len(a) ELSE 0.0 END AS p, CASE WHEN len(t) > 0 THEN sh / len(t) ELSE 0.0 END AS r FROM i),
s0 AS (SELECT *, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, contains(na, nt) AS contains FROM pr), s AS (SELECT *, contains OR f1 >= 0.5 AS passed FROM s0)"""
_OK = f"coalesce(CASE WHEN regexp_matches({{c}}, '[一-鿿]') THEN regexp_extract_all(regexp_replace({{c}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+', '', 'g'), '.') ELSE list_filter(regexp_split_to_array(lower({{c}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({Q.quoted(OVERLAP_STOPWORDS)})) END, [])"
_KA, _KT = _OK.format(c="answer"), _OK.format(c="ground_truth")
QUERIES = {f.__name__: f for f in (a5_fuzzy_scores, a6_token_f1, a9_keyword_coverage, a10_overlap, a11_rates, a12_macro_micro, a16_cluster_performance, a22_diagnosis, a23_regressions, a25_type_share, a26_threshold_sweep, a28_case_split, a29_extraction_coverage, a30_version_diff, m1_loss_features)}
ORACLE = {
    "a6_token_f1": _SC + " SELECT result_id, precision, recall, f1, contains, passed FROM s",
    "a9_keyword_coverage": f"WITH {Q.RESULTS}, k AS (SELECT result_id, lower(coalesce(answer, '')) AS l, {Q.words('ground_truth')} AS k FROM res) SELECT result_id, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(l, lower(x)))) / len(k)::DOUBLE ELSE 0.0 END, 6) AS coverage FROM k",
    "a10_overlap": f"WITH {Q.RESULTS}, k AS (SELECT result_id, {_KA} AS a, {_KT} AS t FROM res) SELECT result_id, round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: list_contains(a, x))) / len(t)::DOUBLE ELSE 0.0 END, 6) AS overlap FROM k",
    "a11_rates": _SC + " SELECT conv_id, agent_name, count(*) AS n, sum(passed::INT)::BIGINT AS passed, round(avg(passed::INT), 6) AS rate FROM s GROUP BY 1, 2",
    "a12_macro_micro": _SC + " SELECT 'macro' AS kind, 'all' AS category, round(avg(r), 6) AS rate FROM (SELECT avg(passed::INT) AS r FROM s GROUP BY conv_id) UNION ALL SELECT 'micro', fact_type, round(avg(passed::INT), 6) FROM s GROUP BY fact_type",
    "a16_cluster_performance": _SC + f", {Q.FACTS}, g AS (SELECT coalesce(CASE WHEN fct.fact_id IS NULL THEN NULL ELSE coalesce(difficulty, 'none') END, 'unknown') AS cluster, count(*) AS n, round(avg(passed::INT), 6) AS recall, round(avg(fuzzy_score), 6) AS mean_fuzzy FROM s LEFT JOIN fct ON fct.fact_id = s.fact_id GROUP BY 1) SELECT *, round(1 - recall, 6) AS vulnerability, round(1 + round(1 - recall, 6), 6) AS weight FROM g",
    "a22_diagnosis": _SC + " SELECT agent_name, CASE WHEN trim(lower(coalesce(answer, '')), ' ') = '' THEN 'NO_INFO' WHEN contains(lower(coalesce(answer, '')), 'no information') OR contains(lower(coalesce(answer, '')), 'not mentioned') OR contains(lower(coalesce(answer, '')), 'i don''t know') THEN 'CLAIMED_NO_INFO' WHEN f1 > 0.3 THEN 'PARTIAL' WHEN f1 > 0 THEN 'LOW' ELSE 'TOTAL_MISS' END AS cause, count(*) AS n FROM s WHERE NOT passed GROUP BY 1, 2",
    "a23_regressions": _SC + ", g AS (SELECT conv_id, fact_id, agent_name, bool_or(passed) AS passed FROM s GROUP BY 1, 2, 3) SELECT a.conv_id, a.fact_id FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.fact_id = b.fact_id WHERE a.agent_name = 'native' AND NOT a.passed AND b.agent_name = 'rag' AND b.passed",
    "a25_type_share": f"WITH {Q.ART} SELECT obj_type, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM art GROUP BY 1",
    "a26_threshold_sweep": _SC + " SELECT config, agent_name, round(avg((f1 >= bar)::INT), 6) AS rate FROM s, (VALUES ('low', 0.3), ('default', 0.5), ('high', 0.7), ('very_high', 0.8)) c(config, bar) GROUP BY 1, 2",
    "a28_case_split": _SC + " SELECT fact_type, passed, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(latency_ms) FILTER (WHERE latency_ms >= 0), 4) AS mean_latency FROM s GROUP BY 1, 2",
    "a29_extraction_coverage": f"WITH {Q.ART}, {Q.FACTS}, said AS (SELECT DISTINCT conv_id, unnest({Q.bm25("concat_ws(' ', content, quote)")}) AS w FROM art), want AS (SELECT fact_id, conv_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS w FROM (SELECT fact_id, conv_id, list_distinct({Q.bm25('ground_truth')}) AS t FROM fct)), sh AS (SELECT fact_id, round(coalesce(count(said.w) / nullif(count(want.w), 0)::DOUBLE, 0.0), 6) AS share FROM want LEFT JOIN said ON said.conv_id = want.conv_id AND said.w = want.w GROUP BY 1) SELECT *, CASE WHEN share >= 0.8 THEN 'covered' WHEN share >= 0.3 THEN 'partial' ELSE 'missing' END AS bucket FROM sh",
    "a30_version_diff": _SC + ", a AS (SELECT DISTINCT fact_id FROM s WHERE NOT passed AND agent_name = 'native'), b AS (SELECT DISTINCT fact_id FROM s WHERE NOT passed AND agent_name = 'summarization') SELECT fact_id, 'fixed' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT fact_id, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "m1_loss_features": f"WITH {Q.FACTS}, w AS (SELECT *, {Q.words('content')} AS w FROM fct) SELECT fact_id, (turn_id < 35)::INT AS was_lost, length(content) AS n_chars, len(w) AS n_words, coalesce(regexp_matches(content, '[0-9]'), false)::INT AS digits, coalesce(list_bool_or(list_transform(w, lambda x, i: i > 1 AND regexp_matches(x, '^\\p{{Lu}}') AND x <> upper(x) AND NOT ends_with(w[i - 1], '.'))), false)::INT AS names, " + ", ".join(f"coalesce((fact_type = '{k}')::INT, 0) AS is_{k}" for k in ("decision", "requirement", "constraint", "preference")) + ", " + ", ".join(f"coalesce((difficulty = '{k}')::INT, 0) AS is_{k}" for k in ("easy", "medium", "hard", "adversarial")) + " FROM w",
}
