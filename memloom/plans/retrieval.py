"""Queries of vectors and ranked retrieval: the facts' test questions against the artifacts of their conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.operators import retrieval as R
from memloom.plans import sqltext as Q
from memloom.plans.texts import artifacts, facts
from memloom.sources.tables import once, table


def _text():
    return F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("quote", F.lit("")))


def docs(spark, folder) -> DataFrame:
    t = _text()
    return artifacts(spark, folder).select("conv_id", F.col("id").alias("doc_id"), "turn_id", "obj_type", "content", "quote", "event_time_raw", V.unit(V.hash_vector(t)).alias("vec"), X.bm25_tokens(t).alias("tokens"))


def questions(spark, folder) -> DataFrame:
    q = F.col("test_question")
    return facts(spark, folder).where("test_question is not null").select("conv_id", F.col("fact_id").alias("q_id"), q.alias("question"), V.unit(V.hash_vector(q)).alias("vec"), X.bm25_tokens(q).alias("tokens"))


def e1_hash_embeddings(spark, folder):
    v = V.unit(V.hash_vector(F.col("content")))
    raw = V.hash_vector(F.col("content"), centred=False)
    return artifacts(spark, folder).select("id", *[F.round(v[i], 6).alias(f"v{i}") for i in range(16)], F.round(V.norm(raw), 6).alias("raw_norm"))


def e4_chunk_cosines(spark, folder):
    c = once(table(spark, folder, "chunks"), "chunk_id", order=("created_at",)).where(V.usable(F.col("embedding"), 128))
    before = F.lag("embedding").over(Window.partitionBy("conv_id").orderBy("chunk_id"))
    return c.withColumn("before", before).where("before is not null").select("chunk_id", F.round(V.cosine(F.col("embedding"), F.col("before")), 4).alias("cosine"))


def e8_topic_shift(spark, folder):
    c = once(table(spark, folder, "chunks"), "chunk_id", order=("created_at",)).where(V.usable(F.col("embedding"), 128))
    counted = c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk_id")))
    seen = counted.select("conv_id", "chunk_id", "n", F.posexplode("embedding").alias("d", "x"))
    w = Window.partitionBy("conv_id", "d").orderBy("n")
    means = seen.withColumn("recent", F.avg("x").over(w.rowsBetween(-4, 0))).withColumn("earlier", F.avg("x").over(w.rowsBetween(-9, -5))).where("n >= 15")
    sums = means.groupBy("conv_id", "chunk_id").agg(F.sum(F.col("recent") * F.col("earlier")).alias("ab"), F.sum(F.col("recent") * F.col("recent")).alias("aa"), F.sum(F.col("earlier") * F.col("earlier")).alias("bb"))
    return sums.select("conv_id", "chunk_id", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 4).alias("cosine"))


def _out(df):
    return df.select("q_id", "rank", "doc_id", "score")


def q2_semantic_topk(spark, folder):
    return _out(R.retrieve(docs(spark, folder), questions(spark, folder), 5, "semantic"))


def q3_bm25_topk(spark, folder):
    return _out(R.retrieve(docs(spark, folder), questions(spark, folder), 5, "bm25"))


def q1_hybrid_topk(spark, folder):
    return _out(R.retrieve(docs(spark, folder), questions(spark, folder), 5, "hybrid"))


def q1_retrieve_by_type(spark, folder):
    return _out(R.retrieve(docs(spark, folder).where("obj_type = 'decision'"), questions(spark, folder), 5, "hybrid"))


def _top(spark, folder, k: int) -> DataFrame:
    d, q = docs(spark, folder), questions(spark, folder)
    hits = R.retrieve(d, q, k, "bm25")
    return hits.join(d.drop("vec", "tokens"), ["conv_id", "doc_id"]).join(q.select("conv_id", "q_id", "question"), ["conv_id", "q_id"])


def _reranked(spark, folder, score):
    doc = F.concat_ws(" | ", F.coalesce("content", F.lit("")), F.coalesce("quote", F.lit("")))
    top = _top(spark, folder, 20).withColumn("score", F.round(score(F.col("question"), doc), 6)).drop("rank")
    return _out(R.ranked(top, 5))


def q9_rerank_mock(spark, folder):
    return _reranked(spark, folder, R.rerank_mock)


def q11_rerank_fallback(spark, folder):
    return _reranked(spark, folder, R.rerank_fallback)


def q16_expansion_merge(spark, folder):
    d, q = docs(spark, folder), questions(spark, folder)
    wide = R.retrieve(d, q, 8, "bm25")
    narrow = R.retrieve(d, q.withColumn("tokens", X.keyword_set(F.col("question"))), 8, "bm25")
    return R.merged_expansions(wide.unionByName(narrow), 10).select("q_id", "rank", "doc_id", "hits", "score")


def q18_quality_routes(spark, folder):
    hits = R.retrieve(docs(spark, folder), questions(spark, folder), 10, "hybrid")
    asked = questions(spark, folder).select("conv_id", "q_id", X.contains_any(F.col("question"), S.ROUTE_TIME_WORDS).alias("is_temporal"), X.contains_any(F.col("question"), S.ROUTE_ENTITY_WORDS).alias("is_multi_entity"))
    q = R.quality(hits).join(asked, ["conv_id", "q_id"])
    return q.select("q_id", "top_score", "avg_score", "score_spread", "n_results", "is_temporal", "is_multi_entity", R.route(F.col("top_score"), F.col("score_spread"), F.col("n_results"), F.col("is_temporal"), F.col("is_multi_entity")).alias("strategy"))


def q20_temporal_sort(spark, folder):
    top = _top(spark, folder, 10)
    w = Window.partitionBy("q_id").orderBy("turn_id", "rank")
    return top.withColumn("pos", F.row_number().over(w)).where("pos <= 5").select("q_id", "pos", "doc_id", "turn_id")


def q23_temporal_boost(spark, folder):
    timed = F.col("event_time_raw").isNotNull() | F.coalesce(F.col("content").startswith("TIME:"), F.lit(False))
    score = F.when(X.is_temporal(F.col("question")) & timed, F.col("score") * 1.5).otherwise(F.col("score"))
    return _out(R.ranked(_top(spark, folder, 10).withColumn("score", F.round(score, 6)).drop("rank"), 10))


def q25_rank_fusion(spark, folder):
    d, q = docs(spark, folder), questions(spark, folder)
    words = d.select("conv_id", "doc_id", "turn_id", F.explode(X.keyword_set(_text())).alias("w"))
    asked = q.select("conv_id", "q_id", F.explode(X.keyword_set(F.col("question"))).alias("w"))
    matched = asked.join(words, ["conv_id", "w"]).groupBy("conv_id", "q_id", "doc_id", "turn_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conv_id", "q_id").orderBy(F.desc("n"), "turn_id", "doc_id")
    by_word = matched.withColumn("rank", F.row_number().over(w))
    return _out(R.reciprocal_ranks([R.retrieve(d, q, 10, "semantic"), by_word]))


def q29_heuristic_answers(spark, folder):
    top = _top(spark, folder, 3)
    parts = F.array_sort(F.collect_list(F.struct("rank", "quote", "content")))
    joined = F.array_join(F.flatten(F.transform(parts, lambda x: F.filter(F.array(x["quote"], x["content"]), lambda t: F.coalesce(t, F.lit("")) != ""))), " | ")
    got = top.groupBy("q_id").agg(joined.alias("answer"))
    return questions(spark, folder).select("q_id").join(got, "q_id", "left").select("q_id", F.coalesce("answer", F.lit("No relevant context found.")).alias("answer"))


def q32_newest_first(spark, folder):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn_id"), F.desc("id"))
    return artifacts(spark, folder).where("obj_type = 'todo'").select("conv_id", "id", F.row_number().over(w).alias("pos"))


_T = "concat_ws(' ', coalesce(content, ''), coalesce(quote, ''))"


def _hash(text: str, centred: bool = True) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5({text}), {2 * i + 1}, 2))::INT / 255.0::DOUBLE - {0.5 if centred else 0.0}" for i in range(16)) + "]::DOUBLE[]"


_BASE = f"""
WITH {Q.ART}, {Q.FACTS},
d AS (SELECT conv_id, id AS doc_id, turn_id, obj_type, content, quote, event_time_raw, {_T} AS txt FROM art @where@),
q AS (SELECT conv_id, fact_id AS q_id, test_question AS question FROM fct WHERE test_question IS NOT NULL),
tk AS (SELECT conv_id, doc_id, {Q.bm25('txt')} AS t FROM d),
corpus AS (SELECT conv_id, count(*) AS n, avg(len(t)) AS avgdl FROM tk GROUP BY 1),
tf AS (SELECT conv_id, doc_id, dl, term, count(*) AS tf FROM (SELECT conv_id, doc_id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
i0 AS (SELECT conv_id, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN corpus USING (conv_id)),
i1 AS (SELECT conv_id, term, avgdl, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY conv_id) ELSE idf END AS idf FROM i0)
"""


def _lexical(name: str, tokens: str) -> str:
    return f"""
{name}_t AS (SELECT conv_id, q_id, term, count(*) AS times FROM (SELECT conv_id, q_id, unnest({tokens}) AS term FROM q) GROUP BY ALL),
{name}_r AS (SELECT conv_id, q_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM {name}_t JOIN i1 USING (conv_id, term) JOIN tf USING (conv_id, term) GROUP BY ALL),
{name} AS (SELECT conv_id, q_id, doc_id, round(raw / m, 6) AS score FROM (SELECT *, max(raw) OVER (PARTITION BY conv_id, q_id) AS m FROM {name}_r) WHERE m > 0 AND raw > 0)"""


_LEX = _lexical("lex", Q.bm25("question"))
_SEM = f"""
dv AS (SELECT conv_id, doc_id, {_hash('txt')} AS v FROM d),
qv AS (SELECT conv_id, q_id, {_hash('question')} AS v FROM q),
sem AS (SELECT qv.conv_id, q_id, doc_id, round(list_cosine_similarity(qv.v, dv.v), 6) AS score FROM qv JOIN dv USING (conv_id))"""
_HYB = """
hyb AS (SELECT * FROM (SELECT conv_id, q_id, doc_id, round(0.7 * coalesce(sem.score, 0) + 0.3 * coalesce(lex.score, 0), 7) AS score FROM sem FULL JOIN lex USING (conv_id, q_id, doc_id)) WHERE score > 0)"""


def _best(source: str, k: int, columns: str = "q_id, rank, doc_id, score") -> str:
    return f" SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


def _base(where: str = "") -> str:
    return _BASE.replace("@where@", where)


def _topk(k: int) -> str:
    return f"top AS (SELECT r.*, d.* EXCLUDE (conv_id, doc_id), question FROM ({_best('lex', k, 'conv_id, q_id, rank, doc_id, score')}) r JOIN d ON d.conv_id = r.conv_id AND d.doc_id = r.doc_id JOIN q ON q.conv_id = r.conv_id AND q.q_id = r.q_id)"


_QS, _DS = f"list_distinct({Q.words('lower(question)')})", f"list_distinct({Q.words('lower(doc)')})"
_SHARE = f"CASE WHEN len({_QS}) > 0 THEN len(list_intersect({_QS}, {_DS})) / len({_QS})::DOUBLE ELSE 0.0 END"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 128 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_CHUNKS = f"c AS (SELECT * FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at) = 1) WHERE {_USABLE})"

QUERIES = {f.__name__: f for f in (e1_hash_embeddings, e4_chunk_cosines, e8_topic_shift, q1_hybrid_topk, q1_retrieve_by_type, q2_semantic_topk, q3_bm25_topk, q9_rerank_mock, q11_rerank_fallback, q16_expansion_merge, q18_quality_routes, q20_temporal_sort, q23_temporal_boost, q25_rank_fusion, q29_heuristic_answers, q32_newest_first)}


def _rerank(score: str) -> str:
    return f"{_base()},{_LEX},{_topk(20)}, s AS (SELECT conv_id, q_id, doc_id, round({score}, 6) AS score FROM (SELECT *, concat_ws(' | ', coalesce(content, ''), coalesce(quote, '')) AS doc FROM top))" + _best("s", 5)


ORACLE = {
    "e1_hash_embeddings": f"WITH {Q.ART}, v AS (SELECT id, {_hash("coalesce(content, '')")} AS v, {_hash("coalesce(content, '')", False)} AS r FROM art) SELECT id, " + ", ".join(f"round(v[{i + 1}] / sqrt(list_dot_product(v, v)), 6) AS v{i}" for i in range(16)) + ", round(sqrt(list_dot_product(r, r)), 6) AS raw_norm FROM v",
    "e4_chunk_cosines": f"WITH {_CHUNKS} SELECT chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]), 4) AS cosine FROM (SELECT *, lag(embedding) OVER (PARTITION BY conv_id ORDER BY chunk_id) AS b FROM c) WHERE b IS NOT NULL",
    "e8_topic_shift": f"WITH {_CHUNKS}, s AS (SELECT conv_id, chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY chunk_id) AS n, unnest(range(128)) AS d, unnest(embedding)::DOUBLE AS x FROM c), m AS (SELECT *, avg(x) OVER (PARTITION BY conv_id, d ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, avg(x) OVER (PARTITION BY conv_id, d ORDER BY n ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS b FROM s) SELECT conv_id, chunk_id, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 4) AS cosine FROM m WHERE n >= 15 GROUP BY ALL",
    "q1_hybrid_topk": f"{_base()},{_LEX},{_SEM},{_HYB}" + _best("hyb", 5),
    "q1_retrieve_by_type": _base("WHERE obj_type = 'decision'") + f",{_LEX},{_SEM},{_HYB}" + _best("hyb", 5),
    "q2_semantic_topk": f"{_base()},{_SEM}" + _best("sem", 5),
    "q3_bm25_topk": f"{_base()},{_LEX}" + _best("lex", 5),
    "q9_rerank_mock": _rerank(f"0.6 * ({_SHARE}) + 0.2 / (1 + abs(length(doc) - 200) / 200.0) + ('0x' || substr(md5(question || '|' || doc), 1, 2))::INT / 255.0 * 0.2"),
    "q11_rerank_fallback": _rerank(f"({_SHARE}) + CASE WHEN contains(lower(doc), lower(question)) THEN 0.5 ELSE 0.0 END"),
    "q16_expansion_merge": f"{_base()},{_LEX},{_lexical('nar', Q.keywords('question'))}, u AS ({_best('lex', 8, 'conv_id, q_id, doc_id, score')} UNION ALL {_best('nar', 8, 'conv_id, q_id, doc_id, score')}), g AS (SELECT conv_id, q_id, doc_id, max(score) AS b, count(*) AS hits FROM u GROUP BY ALL), s AS (SELECT conv_id, q_id, doc_id, hits, round(CASE WHEN hits > 1 THEN least(b * (1 + least(0.05 * (hits - 1), 0.15)), 1.0) ELSE b END, 6) AS score FROM g)" + _best("s", 10, "q_id, rank, doc_id, hits, score"),
    "q18_quality_routes": f"{_base()},{_LEX},{_SEM},{_HYB}, t AS ({_best('hyb', 10, 'conv_id, q_id, score')}), g AS (SELECT conv_id, q_id, max(score) AS top_score, round(avg(score), 10) AS avg_score, round(max(score) - min(score), 7) AS score_spread, count(*) AS n_results FROM t GROUP BY ALL), f AS (SELECT g.*, {Q.any_of('question', S.ROUTE_TIME_WORDS)} AS is_temporal, {Q.any_of('question', S.ROUTE_ENTITY_WORDS)} AS is_multi_entity FROM g JOIN q USING (conv_id, q_id)) SELECT * EXCLUDE (conv_id), CASE WHEN top_score > 0.85 AND score_spread > 0.3 THEN 'direct' WHEN top_score < 0.5 THEN 'expand' WHEN is_temporal AND n_results >= 3 THEN 'temporal_sort' WHEN is_multi_entity OR score_spread < 0.15 THEN 'multi_round' ELSE 'direct' END AS strategy FROM f",
    "q20_temporal_sort": f"{_base()},{_LEX},{_topk(10)} SELECT q_id, pos, doc_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY turn_id, rank) AS pos FROM top) WHERE pos <= 5",
    "q23_temporal_boost": f"{_base()},{_LEX},{_topk(10)}, s AS (SELECT conv_id, q_id, doc_id, round(CASE WHEN {Q.any_of('question', S.TEMPORAL_WORDS)} AND (event_time_raw IS NOT NULL OR coalesce(starts_with(content, 'TIME:'), false)) THEN score * 1.5 ELSE score END, 6) AS score FROM top)" + _best("s", 10),
    "q25_rank_fusion": f"{_base()},{_SEM}, dw AS (SELECT conv_id, doc_id, turn_id, unnest({Q.keywords('txt')}) AS w FROM d), qw AS (SELECT conv_id, q_id, unnest({Q.keywords('question')}) AS w FROM q), m AS (SELECT conv_id, q_id, doc_id, turn_id, count(*) AS n FROM qw JOIN dw USING (conv_id, w) GROUP BY ALL), l AS ({_best('sem', 10, 'conv_id, q_id, doc_id, rank')} UNION ALL SELECT conv_id, q_id, doc_id, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY n DESC, turn_id, doc_id) FROM m), s AS (SELECT conv_id, q_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY ALL)" + _best("s", 10),
    "q29_heuristic_answers": f"{_base()},{_LEX},{_topk(3)}, p AS (SELECT q_id, rank, 1 AS o, quote AS t FROM top UNION ALL SELECT q_id, rank, 2, content FROM top), a AS (SELECT q_id, string_agg(t, ' | ' ORDER BY rank, o) AS answer FROM p WHERE coalesce(t, '') <> '' GROUP BY 1), b AS (SELECT DISTINCT q_id, '' AS none FROM top) SELECT q.q_id, CASE WHEN b.q_id IS NULL THEN 'No relevant context found.' ELSE coalesce(a.answer, '') END AS answer FROM q LEFT JOIN b USING (q_id) LEFT JOIN a USING (q_id)",
    "q32_newest_first": f"WITH {Q.ART} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC, id DESC) AS pos FROM art WHERE obj_type = 'todo'",
}
