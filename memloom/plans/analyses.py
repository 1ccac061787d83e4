"""Queries of stemmed and judged scores, recall of retrieval, clusters of failures, and training data of the learned parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.functions.stemming import stems
from memloom.operators import backends as B
from memloom.operators import learning as L
from memloom.operators import metrics as M
from memloom.operators import retrieval as R
from memloom.operators import selection as P
from memloom.plans import sqltext as Q
from memloom.plans.metrics import _SC, _scored
from memloom.plans.metrics import a16_cluster_performance as clusters
from memloom.plans.retrieval import _LEX, _base, _best, _hash, docs, questions
from memloom.plans.storage import ORACLE as _STORED
from memloom.plans.texts import artifacts, facts, results
from memloom.sources.tables import once, table


def f9_stems(spark, folder):
    """Stems of the normalised answers, by distinct word: each word of the corpus is stemmed once."""
    words = results(spark, folder).select(F.explode(X.words(X.normalised(F.col("answer")))).alias("word")).distinct()
    return words.select("word", stems(F.array("word"))[0].alias("stem"))


def a6_stemmed_f1(spark, folder):
    s = M.token_f1(F.col("answer"), F.col("ground_truth"), stemmed=True)
    return results(spark, folder).select("result_id", *[F.round(c, 6).alias(k) for k, c in s.items()])


def a7_answer_scores(spark, folder):
    """Pass by F1 of one half, or by containment; an empty truth is contained."""
    return _scored(spark, folder).select("result_id", F.col("contains").alias("exact"), "f1", "passed")


def a8_judged_answers(spark, folder):
    """A judge that says CORRECT where the truth is in the answer; it fails on missing answers, for which F1 stands."""

    def judge(question: str, answer: str, truth: str) -> str:
        if not answer:
            raise ValueError("no answer")
        return "correct" if truth.lower() in answer.lower() else "wrong"

    rows = _scored(spark, folder).select("result_id", "question", "answer", "ground_truth", "f1", "contains")
    judged = B.answer_judged(rows, judge, "f1")
    return judged.select("result_id", F.round("verdict", 6).alias("verdict"), (F.col("contains") | (F.col("verdict") >= 0.5)).alias("passed"))


def _covered(spark, folder):
    k = X.words(F.col("ground_truth"))
    share = F.round(M.keyword_coverage(F.col("answer"), k), 6)
    return results(spark, folder).withColumn("coverage", share).withColumn("all_found", (F.size(k) == 0) | (share == 1.0)).withColumn("passed", share >= 0.8)


def a9_multihop_scores(spark, folder):
    """Coverage of the truth's words, passed from 0.8 on; without words nothing is covered, yet all is found."""
    return _covered(spark, folder).select("result_id", "coverage", "all_found", "passed")


def a14_summary_by_relation(spark, folder):
    """Means over all questions about facts with a relation of each type."""
    r = once(table(spark, folder, "fact_relations"), "rel_id", order=("loaded_at",)).select(F.col("source_id").alias("fact_id"), "relation_type").distinct()
    return _covered(spark, folder).join(r, "fact_id").groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


def a15_retrieval_recall(spark, folder):
    """Shared words of the truth and the five best results, as sets: per conversation, per fact type, and over all."""
    hits = R.retrieve(docs(spark, folder), questions(spark, folder), 5, "bm25").join(artifacts(spark, folder).select("conv_id", F.col("id").alias("doc_id"), "content"), ["conv_id", "doc_id"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), " ")
    found = hits.groupBy("conv_id", "q_id").agg(text.alias("found"))
    f = facts(spark, folder).where("test_question is not null").select("conv_id", F.col("fact_id").alias("q_id"), F.coalesce("fact_type", F.lit("none")).alias("fact_type"), "ground_truth")
    both = f.join(found, ["conv_id", "q_id"], "left")
    a, t = (F.array_distinct(X.words(X.normalised(F.col(c)))) for c in ("found", "ground_truth"))
    shared = F.size(F.array_intersect(a, t))
    p, r = (F.when(F.size(x) > 0, shared / F.size(x)).otherwise(0.0) for x in (a, t))
    rows = both.select("conv_id", "fact_type", p.alias("p"), r.alias("r"), M.contained(F.col("found"), F.col("ground_truth")).cast("double").alias("c")).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    each = F.explode(F.array(F.struct(F.lit("conversation").alias("level"), F.col("conv_id").alias("key")), F.struct(F.lit("type").alias("level"), F.col("fact_type").alias("key")), F.struct(F.lit("all").alias("level"), F.lit("all").alias("key"))))
    means = [F.round(F.avg(c), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"), ("c", "contains"))]
    return rows.withColumn("g", each).groupBy("g.level", "g.key").agg(F.count("*").alias("n"), *means)


def _by_cluster(spark, folder):
    c = clusters(spark, folder).select("cluster", "vulnerability")
    f = facts(spark, folder).select("fact_id", F.coalesce("difficulty", F.lit("none")).alias("cluster"))
    return _scored(spark, folder).join(f, "fact_id", "left").join(c, "cluster", "left").withColumn("v", F.coalesce("vulnerability", F.lit(0.5)))


def a18_cluster_simulation(spark, folder):
    """Whether failed results lie in more vulnerable clusters; a result without a cluster counts one half."""
    means = _by_cluster(spark, folder).agg(F.round(F.avg(F.when(~F.col("passed"), F.col("v"))), 6).alias("failed"), F.round(F.avg(F.when(F.col("passed"), F.col("v"))), 6).alias("passed"))
    return means.withColumn("gap", F.round(F.col("failed") - F.col("passed"), 6)).withColumn("would_help", F.col("gap") > 0.05)


def a19_vulnerable_clusters(spark, folder):
    return clusters(spark, folder).where("recall < 1 and n >= 3").select("cluster", "n", "recall")


def a20_boosts(spark, folder):
    """What a rule and a learned weight add to a fact: earlier turns, and more vulnerable clusters."""
    c = clusters(spark, folder).select("cluster", "vulnerability")
    f = facts(spark, folder).withColumn("cluster", F.coalesce("difficulty", F.lit("none"))).join(c, "cluster", "left")
    return f.select("fact_id", F.round(1 + 0.1 * (1 - F.col("turn_id") / 50), 6).alias("rule_boost"), F.round(1 + 0.2 * F.coalesce("vulnerability", F.lit(0.5)), 6).alias("learned_boost"))


def a21_improvement(spark, folder):
    """Failures per cluster, those that a vulnerable cluster explains, and how many of them half and full prevention would save."""
    g = _by_cluster(spark, folder).where("not passed").groupBy(F.coalesce("cluster", F.lit("unknown")).alias("cluster")).agg(F.count("*").alias("failures"), F.sum((F.col("v") > 0.05).cast("long")).alias("preventable"))
    return g.withColumn("optimistic", F.col("preventable").cast("double")).withColumn("conservative", F.col("preventable") * 0.5)


def a24_chosen_questions(spark, folder):
    """The first twenty questions of chosen types of each conversation."""
    f = facts(spark, folder).where("test_question is not null and fact_type in ('decision', 'constraint')")
    w = Window.partitionBy("conv_id").orderBy("turn_id", "fact_id")
    return f.withColumn("pos", F.row_number().over(w)).where("pos <= 20").select("fact_id", "pos")


def a25_types_of_clusters(spark, folder):
    """The three most frequent types of each cluster, with the share and the first sample."""
    n = facts(spark, folder).groupBy(F.coalesce("difficulty", F.lit("none")).alias("cluster"), F.coalesce("fact_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.min("fact_id").alias("sample"))
    w = Window.partitionBy("cluster")
    r = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "kind")))
    return r.where("rank <= 3")


def a27_pilot_coverage(spark, folder):
    """Keywords of the truths that the answers of each agent hold, over all its keywords."""
    k = X.keyword_set(F.col("ground_truth"))
    found = F.size(F.filter(k, lambda w: F.lower(F.coalesce("answer", F.lit(""))).contains(w)))
    g = results(spark, folder).groupBy("agent_name").agg(F.sum(found.cast("long")).alias("found"), F.sum(F.size(k).cast("long")).alias("total"))
    return g.withColumn("coverage", F.round(F.coalesce(F.try_divide("found", "total"), F.lit(0.0)), 6))


# fixed values: tokens that each way of remembering shows a question, in turns, chunks or rows times tokens of each
SHOWN = [("full_context", 200, 50), ("summary", 1, 2000), ("rag", 5, 300), ("graphrag", 1, 3000), ("graph_memory", 25, 50)]


def a31_token_estimates(spark, folder):
    n = questions(spark, folder).agg(F.count("*").alias("n_questions"))
    t = spark.createDataFrame(SHOWN, "method string, items long, each long")  # five rows
    return t.crossJoin(F.broadcast(n)).select("method", (F.col("items") * F.col("each")).alias("per_question"), (F.col("items") * F.col("each") * F.col("n_questions")).alias("total"))


def _recall_labels(spark, folder):
    s = _scored(spark, folder).groupBy("fact_id").agg(F.max(F.col("passed").cast("int")).alias("passed"), F.max(F.coalesce("fuzzy_score", F.lit(0.0))).alias("fuzzy"))
    v = F.when(F.col("passed") == 1, 0.0).otherwise(1 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("fuzzy"))) / 100)
    return facts(spark, folder).join(s, "fact_id").withColumn("vulnerability", F.round(v, 6))


def m2_recall_labels(spark, folder):
    """How badly each asked fact was recalled, with the features a model sees."""
    c = F.col("content")
    return _recall_labels(spark, folder).select("fact_id", "vulnerability", "turn_id", F.length(c).alias("n_chars"), F.size(X.words(c)).alias("n_words"), X.has_digits(c).cast("int").alias("digits"))


def m5_cluster_statistics(spark, folder):
    g = _recall_labels(spark, folder).groupBy(F.coalesce("difficulty", F.lit("none")).alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg("vulnerability"), 6).alias("mean"), F.round(F.stddev_pop("vulnerability"), 6).alias("spread"))
    return g.withColumn("level", F.when(F.col("mean") > 0.1, "HIGH").when(F.col("mean") > 0.03, "MODERATE").otherwise("LOW"))


def m6_contrastive_pairs(spark, folder):
    """Five hundred pairs of facts in the order of a seeded hash, with the similarity that their labels ask for."""
    f = _recall_labels(spark, folder).select("fact_id", "vulnerability", F.md5(F.concat("fact_id", F.lit("|42"))).alias("h")).orderBy("h").limit(1000)
    r = f.withColumn("r", F.row_number().over(Window.orderBy("h")) - 1)  # a thousand rows
    one, two = (r.where(f"r % 2 = {k}").select(F.floor(F.col("r") / 2).alias("p"), F.col("fact_id").alias(n), F.col("vulnerability").alias(v)) for k, n, v in ((0, "a", "va"), (1, "b", "vb")))
    gap = F.round(F.abs(F.col("va") - F.col("vb")), 6)
    return one.join(two, "p").select("a", "b", F.round(F.when(gap < 0.1, 1.0).when(gap > 0.3, 0.0).otherwise(1 - gap), 6).alias("similarity"))


def v11_learned_prioritised(spark, folder):
    """The ten rows of greatest gain by learned importance and, without a fitted model, retention by recency."""
    a = artifacts(spark, folder)
    rates = a.groupBy("obj_type").agg(F.avg((F.col("confidence") >= 0.7).cast("double")).alias("rate"))
    total = a.groupBy("conv_id").agg(F.max("turn_id").alias("total"))
    recent = F.when(F.col("total") <= 0, F.lit(1.0)).otherwise(F.col("turn_id") / F.col("total"))
    s = a.join(L.learned_importance(a, rates), "id").join(total, "conv_id").withColumn("delta", F.round(F.col("importance") * (1 - (0.1 + 0.8 * recent)), 9))
    return P.prioritised(s).select("id", "rank")


def e2_raw_vectors(spark, folder):
    """The mock model's other vectors: the bytes as they are, neither centred nor of length one."""
    v = V.hash_vector(F.col("content"), centred=False)
    return artifacts(spark, folder).select("id", *[F.round(v[i], 6).alias(f"v{i}") for i in (0, 7, 15)])


def e5_one_against_many(spark, folder):
    """The first question of each conversation against all its artifacts."""
    q = questions(spark, folder).groupBy("conv_id").agg(F.min_by("vec", "q_id").alias("qv"))
    return docs(spark, folder).join(q, "conv_id").select(F.col("doc_id").alias("id"), F.round(V.cosine(F.col("qv"), F.col("vec")), 6).alias("cosine"))


_CL = _SC + f", {Q.FACTS}, sc AS (SELECT s.*, CASE WHEN fct.fact_id IS NULL THEN NULL ELSE coalesce(difficulty, 'none') END AS cluster FROM s LEFT JOIN fct ON fct.fact_id = s.fact_id), cl AS (SELECT coalesce(cluster, 'unknown') AS cluster, count(*) AS n, round(avg(passed::INT), 6) AS recall FROM sc GROUP BY 1), vv AS (SELECT cluster, round(1 - recall, 6) AS vulnerability FROM cl), sv AS (SELECT sc.*, coalesce(vulnerability, 0.5) AS v FROM sc LEFT JOIN vv ON vv.cluster = sc.cluster)"
_CO = f"co AS (SELECT *, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda x: contains(l, lower(x)))) / len(k)::DOUBLE ELSE 0.0 END, 6) AS coverage FROM (SELECT *, lower(coalesce(answer, '')) AS l, {Q.words('ground_truth')} AS k FROM res))"
_LB = _SC + f", {Q.FACTS}, lb AS (SELECT fct.*, round(CASE WHEN p = 1 THEN 0.0 ELSE 1 - least(100.0, greatest(0.0, f)) / 100 END, 6) AS vulnerability FROM fct JOIN (SELECT fact_id, max(passed::INT) AS p, max(coalesce(fuzzy_score, 0.0)) AS f FROM s GROUP BY 1) g ON g.fact_id = fct.fact_id)"
_FW, _GW = f"list_distinct({Q.words(Q.normalised('found'))})", f"list_distinct({Q.words(Q.normalised('ground_truth'))})"
_V10 = _STORED["v10_learned_importance"]
QUERIES = {f.__name__: f for f in (f9_stems, a6_stemmed_f1, a7_answer_scores, a8_judged_answers, a9_multihop_scores, a14_summary_by_relation, a15_retrieval_recall, a18_cluster_simulation, a19_vulnerable_clusters, a20_boosts, a21_improvement, a24_chosen_questions, a25_types_of_clusters, a27_pilot_coverage, a31_token_estimates, m2_recall_labels, m5_cluster_statistics, m6_contrastive_pairs, v11_learned_prioritised, e2_raw_vectors, e5_one_against_many)}
ORACLE = {
    "a7_answer_scores": _SC + " SELECT result_id, contains AS exact, f1, passed FROM s",
    "a8_judged_answers": _SC + ", v AS (SELECT *, CASE WHEN coalesce(answer, '') = '' THEN f1 WHEN contains(lower(answer), lower(coalesce(ground_truth, ''))) THEN 1.0 ELSE 0.0 END AS verdict FROM s) SELECT result_id, round(verdict, 6) AS verdict, contains OR verdict >= 0.5 AS passed FROM v",
    "a9_multihop_scores": f"WITH {Q.RESULTS}, {_CO} SELECT result_id, coverage, len(k) = 0 OR coverage = 1.0 AS all_found, coverage >= 0.8 AS passed FROM co",
    "a14_summary_by_relation": f"WITH {Q.RESULTS}, {_CO}, r AS (SELECT DISTINCT source_id, relation_type FROM (SELECT * FROM fact_relations QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at) = 1)) SELECT relation_type, count(*) AS n, round(avg(coverage), 6) AS coverage, round(avg((coverage >= 0.8)::INT), 6) AS pass_rate FROM co JOIN r ON source_id = fact_id GROUP BY 1",
    "a15_retrieval_recall": f"{_base()},{_LEX}, t AS ({_best('lex', 5, 'conv_id, q_id, rank, doc_id')}), fo AS (SELECT t.conv_id, q_id, string_agg(coalesce(content, ''), ' ' ORDER BY rank) AS found FROM t JOIN d ON d.conv_id = t.conv_id AND d.doc_id = t.doc_id GROUP BY ALL), b AS (SELECT fct.conv_id, coalesce(fact_type, 'none') AS fact_type, {_FW} AS a, {_GW} AS t, contains({Q.normalised('found')}, {Q.normalised('ground_truth')})::INT AS c FROM fct LEFT JOIN fo ON fo.conv_id = fct.conv_id AND fo.q_id = fct.fact_id WHERE test_question IS NOT NULL), p AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, t)) / len(a)::DOUBLE ELSE 0.0 END AS p, CASE WHEN len(t) > 0 THEN len(list_intersect(a, t)) / len(t)::DOUBLE ELSE 0.0 END AS r FROM b), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM p), g AS (SELECT 'conversation' AS level, conv_id AS key, p, r, f, c FROM f UNION ALL SELECT 'type', fact_type, p, r, f, c FROM f UNION ALL SELECT 'all', 'all', p, r, f, c FROM f) SELECT level, key, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, round(avg(c), 6) AS contains FROM g GROUP BY 1, 2",
    "a18_cluster_simulation": _CL + ", m AS (SELECT round(avg(v) FILTER (WHERE NOT passed), 6) AS failed, round(avg(v) FILTER (WHERE passed), 6) AS passed FROM sv) SELECT *, round(failed - passed, 6) AS gap, round(failed - passed, 6) > 0.05 AS would_help FROM m",
    "a19_vulnerable_clusters": _CL + " SELECT cluster, n, recall FROM cl WHERE recall < 1 AND n >= 3",
    "a20_boosts": _CL + " SELECT fact_id, round(1 + 0.1 * (1 - turn_id / 50.0::DOUBLE), 6) AS rule_boost, round(1 + 0.2 * coalesce(vulnerability, 0.5), 6) AS learned_boost FROM fct LEFT JOIN vv ON vv.cluster = coalesce(difficulty, 'none')",
    "a21_improvement": _CL + " SELECT coalesce(cluster, 'unknown') AS cluster, count(*) AS failures, count(*) FILTER (WHERE v > 0.05) AS preventable, count(*) FILTER (WHERE v > 0.05)::DOUBLE AS optimistic, count(*) FILTER (WHERE v > 0.05) * 0.5::DOUBLE AS conservative FROM sv WHERE NOT passed GROUP BY 1",
    "a24_chosen_questions": f"WITH {Q.FACTS} SELECT fact_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, fact_id) AS pos FROM fct WHERE test_question IS NOT NULL AND fact_type IN ('decision', 'constraint')) WHERE pos <= 20",
    "a25_types_of_clusters": f"WITH {Q.FACTS}, n AS (SELECT coalesce(difficulty, 'none') AS cluster, coalesce(fact_type, 'none') AS kind, count(*) AS n, min(fact_id) AS sample FROM fct GROUP BY 1, 2) SELECT * FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY cluster)::DOUBLE, 6) AS share, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, kind) AS rank FROM n) WHERE rank <= 3",
    "a27_pilot_coverage": f"WITH {Q.RESULTS}, k AS (SELECT agent_name, lower(coalesce(answer, '')) AS l, {Q.keywords('ground_truth')} AS k FROM res), g AS (SELECT agent_name, sum(len(list_filter(k, lambda w: contains(l, w))))::BIGINT AS found, sum(len(k))::BIGINT AS total FROM k GROUP BY 1) SELECT *, round(CASE WHEN total > 0 THEN found / total::DOUBLE ELSE 0.0 END, 6) AS coverage FROM g",
    "a31_token_estimates": f"WITH {Q.FACTS} SELECT method, i * e AS per_question, i * e * n AS total FROM (VALUES " + ", ".join(f"('{m}', {i}, {e})" for m, i, e in SHOWN) + ") t(method, i, e), (SELECT count(*) AS n FROM fct WHERE test_question IS NOT NULL)",
    "m2_recall_labels": _LB + f" SELECT fact_id, vulnerability, turn_id, length(content) AS n_chars, len({Q.words('content')}) AS n_words, coalesce(regexp_matches(content, '[0-9]'), false)::INT AS digits FROM lb",
    "m5_cluster_statistics": _LB + ", g AS (SELECT coalesce(difficulty, 'none') AS cluster, count(*) AS n, round(avg(vulnerability), 6) AS mean, round(stddev_pop(vulnerability), 6) AS spread FROM lb GROUP BY 1) SELECT *, CASE WHEN mean > 0.1 THEN 'HIGH' WHEN mean > 0.03 THEN 'MODERATE' ELSE 'LOW' END AS level FROM g",
    "m6_contrastive_pairs": _LB + ", r AS (SELECT fact_id, vulnerability, row_number() OVER (ORDER BY md5(fact_id || '|42')) - 1 AS r FROM lb ORDER BY r LIMIT 1000), p AS (SELECT x.fact_id AS a, y.fact_id AS b, round(abs(x.vulnerability - y.vulnerability), 6) AS gap FROM r x JOIN r y ON y.r = x.r + 1 AND x.r % 2 = 0) SELECT a, b, round(CASE WHEN gap < 0.1 THEN 1.0 WHEN gap > 0.3 THEN 0.0 ELSE 1 - gap END, 6) AS similarity FROM p",
    "v11_learned_prioritised": f"WITH im AS ({_V10}), {Q.ART}, t AS (SELECT *, max(turn_id) OVER (PARTITION BY conv_id) AS total FROM art), d AS (SELECT t.*, round(importance * (1 - (0.1 + 0.8 * CASE WHEN total <= 0 THEN 1.0 ELSE turn_id / total::DOUBLE END)), 9) AS delta FROM t JOIN im ON im.id = t.id) SELECT id, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY delta DESC, turn_id, id) AS rank FROM d) WHERE rank <= 10",
    "e2_raw_vectors": f"WITH {Q.ART}, h AS (SELECT id, {_hash("coalesce(content, '')", False)} AS v FROM art) SELECT id, round(v[1], 6) AS v0, round(v[8], 6) AS v7, round(v[16], 6) AS v15 FROM h",
    "e5_one_against_many": f"{_base()}, o AS (SELECT conv_id, arg_min(question, q_id) AS question FROM q GROUP BY 1) SELECT doc_id AS id, round(list_cosine_similarity({_hash('question')}, {_hash('txt')}), 6) AS cosine FROM d JOIN o ON o.conv_id = d.conv_id",
}
