"""Queries of agents: filtered, reranked and repeated retrieval, routes, contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.operators import backends as B
from memloom.operators import retrieval as R
from memloom.operators import selection as P
from memloom.plans import sqltext as Q
from memloom.plans.retrieval import _HYB, _LEX, _SEM, _SHARE, _base, _best, _hash, _lexical, _out, _top, _topk, docs, questions
from memloom.plans.selections import _DATED
from memloom.session import materialize
from memloom.sources.tables import once, table
from memloom import schema as S


_WIDE_BLOCK = 8_192  # rows of a block: what blocks send on grows with their number


def _hybrid(spark, folder, k: int):
    d, q = docs(spark, folder), questions(spark, folder)
    hits = R.retrieve(d, q, k, "hybrid")
    return hits.join(d.drop("vec", "tokens"), ["conv_id", "doc_id"]).join(q.select("conv_id", "q_id", "question"), ["conv_id", "q_id"])


def q6_retrieve_and_filter(spark, folder):
    """Twenty hybrid candidates, rated and filtered to five."""
    return _out(B.judged(_hybrid(spark, folder, 20), B.shared_word_rating, 5, 0.1).withColumn("score", F.round("score", 6)))


def q8_query_vectors(spark, folder):
    """All questions embedded at once."""
    return questions(spark, folder).select("q_id", *[F.round(F.col("vec")[i], 6).alias(f"v{i}") for i in range(4)])


def q10_backend_rerank(spark, folder):
    return _out(B.reranked(_top(spark, folder, 20), lambda q, ds: [len(d) % 97 for d in ds]))


def q12_rated_rerank(spark, folder):
    """A model's ratings of 0 to 10, out-of-range ones clamped."""
    return _out(B.judged(_top(spark, folder, 20), lambda q, ds: [len(d) % 13 - 1 for d in ds], 5, 0.0))


def q13_reranked_documents(spark, folder):
    """Each question's candidates by fallback score, named by their place in the list that was given."""
    top = _top(spark, folder, 10).withColumn("score", F.round(R.rerank_fallback(F.col("question"), F.coalesce("content", F.lit(""))), 6))
    w = Window.partitionBy("conv_id", "q_id").orderBy(F.desc("score"), "rank")
    return top.withColumn("pos", F.row_number().over(w)).select("q_id", "pos", (F.col("rank") - 1).alias("idx"), "score")


def _doc():
    return F.concat_ws(" | ", F.coalesce("content", F.lit("")), F.coalesce("quote", F.lit("")))


def q14_reranked_hybrid(spark, folder):
    """Hybrid results whose scores a reranker replaces."""
    top = _hybrid(spark, folder, 10).withColumn("score", F.round(R.rerank_mock(F.col("question"), _doc()), 6)).drop("rank")
    return _out(R.ranked(top, 5))


def q17_multi_round(spark, folder):
    """Rounds of five results that were not seen before, at most three, until the results hold 0.7 of the question's words."""
    hits = R.retrieve(docs(spark, folder), questions(spark, folder), 15, "bm25")
    return R.rounds(hits, docs(spark, folder), questions(spark, folder)).select("q_id", "rounds", "confidence", "n_docs")


def q21_routed(spark, folder):
    return questions(spark, folder).select("q_id", F.when(X.complexity(F.col("question")) == "complex", "multi_round").otherwise("single").alias("route"))


def q22_agent_contexts(spark, folder):
    """What a question is answered from: complex ones by merged wordings, temporal ones reranked, the others as retrieved; shown under a budget."""
    d = materialize(docs(spark, folder), "docs")  # every retrieval and the contexts read it
    path = F.when(X.complexity(F.col("question")) == "complex", "expand").when(X.is_temporal(F.col("question")), "rerank").otherwise("plain")
    q = materialize(questions(spark, folder).withColumn("path", path), "asked")
    # each question is retrieved only as its own path asks; both wordings of a question are one retrieval
    wordings = F.explode(F.array(F.struct(F.lit("0").alias("n"), "tokens"), F.struct(F.lit("1").alias("n"), X.keyword_set(F.col("question")).alias("tokens"))))
    asked = q.where("path = 'expand'").select("conv_id", "q_id", "vec", wordings.alias("w")).select("conv_id", F.concat("q_id", "w.n").alias("q_id"), "vec", "w.tokens")
    wide = R.retrieve(d, asked, 8, "bm25", block_rows=_WIDE_BLOCK, stored=True).withColumn("q_id", F.expr("left(q_id, length(q_id) - 1)"))
    cols = ["conv_id", "q_id", "doc_id", "rank"]
    hits = R.merged_expansions(wide, 10).select(*cols).unionByName(R.retrieve(d, q.where("path <> 'expand'"), 10, "hybrid", block_rows=_WIDE_BLOCK, stored=True).select(*cols))
    found = hits.join(d.drop("vec", "tokens"), ["conv_id", "doc_id"]).join(q.select("conv_id", "q_id", "question", "path"), ["conv_id", "q_id"])
    again = F.when(F.col("path") == "rerank", F.round(R.rerank_mock(F.col("question"), _doc()), 6))
    w = Window.partitionBy("conv_id", "q_id").orderBy(F.desc("again"), F.when(F.col("path") == "rerank", F.lit(0)).otherwise(F.col("rank")), "doc_id")
    picked = found.withColumn("again", again).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.when(F.col("path") == "expand", 10).otherwise(5))
    return P.rendered(P.within_budget(picked.withColumn("conv_id", F.col("q_id")), 5000)).select(F.col("conv_id").alias("q_id"), "block")


def q24_rag_chunks(spark, folder):
    """Ten chunks by cosine, reranked to five."""
    c = once(table(spark, folder, "chunks"), "chunk_id", order=("created_at",)).where("trim(coalesce(content, '')) <> ''")
    none = F.array().cast("array<string>")
    d = c.select("conv_id", F.col("chunk_id").cast("string").alias("doc_id"), "content", V.unit(V.hash_vector(F.col("content"))).alias("vec"), none.alias("tokens"))
    q = questions(spark, folder)
    top = R.retrieve(d, q, 10, "semantic").join(d.select("conv_id", "doc_id", "content"), ["conv_id", "doc_id"]).join(q.select("conv_id", "q_id", "question"), ["conv_id", "q_id"])
    return _out(R.ranked(top.withColumn("score", F.round(R.rerank_mock(F.col("question"), F.col("content")), 6)).drop("rank"), 5))


def q30_context_lines(spark, folder):
    line = F.concat(F.lit("- "), F.coalesce("quote", F.lit("")), F.lit("\n  ("), F.coalesce("content", F.lit("")), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return _top(spark, folder, 3).groupBy("q_id").agg(F.array_join(lines, "\n").alias("context"))


_HTOP = f"hyt AS (SELECT r.*, d.* EXCLUDE (conv_id, doc_id), question FROM ({_best('hyb', 20, 'conv_id, q_id, rank, doc_id, score')}) r JOIN d ON d.conv_id = r.conv_id AND d.doc_id = r.doc_id JOIN q ON q.conv_id = r.conv_id AND q.q_id = r.q_id)"
_ALL = f"{_base()},{_LEX},{_SEM},{_HYB},{_HTOP}"
_MOCK = f"0.6 * ({_SHARE}) + 0.2 / (1 + abs(length(doc) - 200) / 200.0) + ('0x' || substr(md5(question || '|' || doc), 1, 2))::INT / 255.0 * 0.2"
_RATE = f"(SELECT conv_id, q_id, doc_id, least(10.0, greatest(0.0, 10 * ({_SHARE}))) / 10 AS score FROM (SELECT *, coalesce(content, '') AS doc FROM @t@))"
_DOC = "concat_ws(' | ', coalesce(content, ''), coalesce(quote, ''))"
_CMP = " OR ".join(f"coalesce(regexp_matches(lower(question), '{p}'), false)" for p in [X.phrase_pattern(S.COMPLEX_PHRASES), *[rf"\b{a}.*{b}\b" for a, b in S.COMPLEX_PAIRS]])
_COMPLEX = f"({_CMP} OR len({Q.words('question')}) > 15)"
_AGAIN = _lexical("lx2", f"{Q.bm25('question')} || more").replace("FROM q)", "FROM q2)")
_MERGED = f"{_lexical('nar', Q.keywords('question'))}, u AS ({_best('lex', 8, 'conv_id, q_id, doc_id, score')} UNION ALL {_best('nar', 8, 'conv_id, q_id, doc_id, score')}), mg AS (SELECT conv_id, q_id, doc_id, round(CASE WHEN count(*) > 1 THEN least(max(score) * (1 + least(0.05 * (count(*) - 1), 0.15)), 1.0) ELSE max(score) END, 6) AS score FROM u GROUP BY ALL)"
QUERIES = {f.__name__: f for f in (q6_retrieve_and_filter, q8_query_vectors, q10_backend_rerank, q12_rated_rerank, q13_reranked_documents, q14_reranked_hybrid, q17_multi_round, q21_routed, q22_agent_contexts, q24_rag_chunks, q30_context_lines)}
ORACLE = {
    "q6_retrieve_and_filter": f"{_ALL}, s AS {_RATE.replace('@t@', 'hyt')}, k AS (SELECT * FROM s WHERE score >= 0.1) SELECT * REPLACE (round(score, 6) AS score) FROM (" + _best("k", 5) + ")",
    "q7_filtered": f"{_base()},{_LEX},{_topk(20)}, s AS {_RATE.replace('@t@', 'top')}, k AS (SELECT * FROM s WHERE score >= 0.1) SELECT * REPLACE (round(score, 6) AS score) FROM (" + _best("k", 5) + ")",
    "q8_query_vectors": f"WITH {Q.FACTS}, h AS (SELECT fact_id AS q_id, {_hash('test_question')} AS v FROM fct WHERE test_question IS NOT NULL) SELECT q_id, " + ", ".join(f"round(v[{i + 1}] / sqrt(list_dot_product(v, v)), 6) AS v{i}" for i in range(4)) + " FROM h",
    "q10_backend_rerank": f"{_base()},{_LEX},{_topk(20)}, s AS (SELECT conv_id, q_id, doc_id, (length(coalesce(content, '')) % 97)::DOUBLE AS score FROM top)" + _best("s", 5),
    "q12_rated_rerank": f"{_base()},{_LEX},{_topk(20)}, s AS (SELECT conv_id, q_id, doc_id, greatest(0, least(10, length(coalesce(content, '')) % 13 - 1)) / 10.0::DOUBLE AS score FROM top)" + _best("s", 5),
    "q13_reranked_documents": f"{_base()},{_LEX},{_topk(10)}, s AS (SELECT conv_id, q_id, rank, round({_SHARE} + CASE WHEN contains(lower(doc), lower(question)) THEN 0.5 ELSE 0.0 END, 6) AS score FROM (SELECT *, coalesce(content, '') AS doc FROM top)) SELECT q_id, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY score DESC, rank) AS pos, rank - 1 AS idx, score FROM s",
    "q14_reranked_hybrid": f"{_ALL}, s AS (SELECT conv_id, q_id, doc_id, round({_MOCK}, 6) AS score FROM (SELECT *, {_DOC} AS doc FROM hyt WHERE rank <= 10))" + _best("s", 5),
    "q17_multi_round": f"{_base()},{_LEX}, t AS ({_best('lex', 15, 'conv_id, q_id, rank, doc_id')}), w AS (SELECT conv_id, q_id, list_distinct({Q.bm25('question')}) AS ws FROM q), f AS (SELECT t.conv_id, t.q_id, term, min((rank - 1) // 5 + 1) AS r FROM (SELECT t.*, unnest(tk.t) AS term FROM t JOIN tk ON tk.conv_id = t.conv_id AND tk.doc_id = t.doc_id) t JOIN w ON w.conv_id = t.conv_id AND w.q_id = t.q_id AND list_contains(ws, term) GROUP BY ALL), c AS (SELECT w.conv_id, w.q_id, " + ", ".join(f"round(count(*) FILTER (WHERE r <= {k}) / greatest(any_value(len(ws)), 1)::DOUBLE, 6) AS c{k}" for k in (1, 2, 3)) + " FROM w JOIN f ON f.conv_id = w.conv_id AND f.q_id = w.q_id GROUP BY ALL), n AS (SELECT conv_id, q_id, count(*) AS n, (count(*) - 1) // 5 + 1 AS mr FROM t GROUP BY ALL), z AS (SELECT n.q_id, n, least(mr, CASE WHEN c1 >= 0.7 THEN 1 WHEN c2 >= 0.7 THEN 2 ELSE 3 END)::INT AS rounds, c1, c2, c3 FROM n JOIN c ON c.conv_id = n.conv_id AND c.q_id = n.q_id) SELECT q_id, rounds, CASE rounds WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS confidence, least(n, 5 * rounds) AS n_docs FROM z",
    "q21_routed": f"WITH {Q.FACTS} SELECT fact_id AS q_id, CASE WHEN {_COMPLEX} THEN 'multi_round' ELSE 'single' END AS route FROM (SELECT *, test_question AS question FROM fct WHERE test_question IS NOT NULL)",
    "q22_agent_contexts": f"{_ALL},{_MERGED}, rr AS (SELECT conv_id, q_id, doc_id, round({_MOCK}, 6) AS score FROM (SELECT *, {_DOC} AS doc FROM hyt WHERE rank <= 10)), pa AS (SELECT conv_id, q_id, CASE WHEN {_COMPLEX} THEN 'expand' WHEN {Q.any_of('question', S.TEMPORAL_WORDS)} THEN 'rerank' ELSE 'plain' END AS path FROM q), al AS (SELECT 'expand' AS path, * FROM ({_best('mg', 10, 'conv_id, q_id, doc_id, rank')}) UNION ALL SELECT 'rerank', * FROM ({_best('rr', 5, 'conv_id, q_id, doc_id, rank')}) UNION ALL SELECT 'plain', conv_id, q_id, doc_id, rank FROM hyt WHERE rank <= 5), ro AS (SELECT al.q_id, rank, d.* FROM al JOIN pa ON pa.conv_id = al.conv_id AND pa.q_id = al.q_id AND pa.path = al.path JOIN d ON d.conv_id = al.conv_id AND d.doc_id = al.doc_id), bu AS (SELECT *, sum(length(coalesce(content, '')) // 4 + 10) OVER (PARTITION BY q_id ORDER BY rank) AS used FROM ro) SELECT q_id, string_agg('[' || upper(substr(obj_type, 1, 1)) || '] ' || {_DATED} || coalesce(content, ''), chr(10) ORDER BY rank) AS block FROM bu WHERE used <= 4995 GROUP BY 1",
    "q24_rag_chunks": f"WITH {Q.FACTS}, c AS (SELECT conv_id, chunk_id::VARCHAR AS doc_id, content FROM chunks WHERE trim(coalesce(content, ''), ' ') <> '' QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at) = 1), q AS (SELECT conv_id, fact_id AS q_id, test_question AS question FROM fct WHERE test_question IS NOT NULL), sem AS (SELECT q.conv_id, q_id, doc_id, round(list_cosine_similarity({_hash('question')}, {_hash('content')}), 6) AS score FROM q JOIN c ON c.conv_id = q.conv_id), t AS ({_best('sem', 10, 'conv_id, q_id, doc_id')}), s AS (SELECT t.conv_id, t.q_id, t.doc_id, round({_MOCK}, 6) AS score FROM (SELECT t.*, question, content AS doc FROM t JOIN c ON c.conv_id = t.conv_id AND c.doc_id = t.doc_id JOIN q ON q.conv_id = t.conv_id AND q.q_id = t.q_id) t)" + _best("s", 5),
    "q30_context_lines": f"{_base()},{_LEX},{_topk(3)} SELECT q_id, string_agg('- ' || coalesce(quote, '') || chr(10) || '  (' || coalesce(content, '') || ')', chr(10) ORDER BY rank) AS context FROM top GROUP BY 1",
    "q31_feedback_round": f"{_base()},{_LEX}, one AS ({_best('lex', 10, 'conv_id, q_id, rank, doc_id')}), q2 AS (SELECT q.*, tk.t AS more FROM q JOIN one ON one.conv_id = q.conv_id AND one.q_id = q.q_id AND rank = 1 JOIN tk ON tk.conv_id = q.conv_id AND tk.doc_id = one.doc_id),{_AGAIN}, b AS (SELECT * FROM one UNION ALL SELECT conv_id, q_id, rank + 10, doc_id FROM ({_best('lx2', 10, 'conv_id, q_id, rank, doc_id')})), m AS (SELECT conv_id, q_id, doc_id, min(rank) AS o FROM b GROUP BY ALL) SELECT q_id, pos, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY o, doc_id) AS pos FROM m) WHERE pos <= 15",
}
