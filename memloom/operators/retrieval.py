"""Ranked retrieval: all questions against all candidates of their conversation, in one plan.

Candidates are (conv_id, doc_id, ...), questions (conv_id, q_id, ...). Ranks are by score
rounded to six places, then by doc_id, so that a result does not depend on the order in
which numbers were added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import blocks


def ranked(scores: DataFrame, most: int | Column, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``most`` per question, with their rank from 1."""
    w = Window.partitionBy("conv_id", "q_id").orderBy(F.desc(by), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def retrieve(docs: DataFrame, questions: DataFrame, most: int | Column = 5, method: str = "hybrid", widest: int = 20, block_rows: int = blocks.BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """Top candidates per question by 'semantic', 'bm25' or 'hybrid'; another method is an error.

    ``most`` may be a column of the questions' own number, of at most ``widest``. ``block_rows`` and ``stored`` are those of ``blocks.scored``.
    """
    if method not in ("semantic", "bm25", "hybrid"):
        raise ValueError(f"unknown method {method!r}")
    return ranked(blocks.scored(docs, questions, most if isinstance(most, int) else widest, method, block_rows=block_rows, stored=stored), most)


def _sets(question: Column, doc: Column) -> tuple[Column, Column]:
    return F.array_distinct(X.words(F.lower(question))), F.array_distinct(X.words(F.lower(doc)))


def overlap_share(question: Column, doc: Column) -> Column:
    q, d = _sets(question, doc)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def rerank_mock(question: Column, doc: Column) -> Column:
    """Shared words, closeness to 200 characters, and a byte of a hash."""
    byte = F.conv(F.substring(F.md5(F.concat(question, F.lit("|"), doc)), 1, 2), 16, 10).cast("double")
    return 0.6 * overlap_share(question, doc) + 0.2 / (1 + F.abs(F.length(doc) - 200) / 200) + byte / 255 * 0.2


def rerank_fallback(question: Column, doc: Column) -> Column:
    """Shared words, and one half more if the document holds the question."""
    return overlap_share(question, doc) + F.when(F.lower(doc).contains(F.lower(question)), 0.5).otherwise(0.0)


def merged_expansions(hits: DataFrame, keep: int) -> DataFrame:
    """Results of several wordings of a question: best score, up to 15 % more for repeated hits, at most 1."""
    per = hits.groupBy("conv_id", "q_id", "doc_id").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    boost = 1 + F.least(0.05 * (F.col("hits") - 1), F.lit(0.15))
    score = F.when(F.col("hits") > 1, F.least(F.col("best") * boost, F.lit(1.0))).otherwise(F.col("best"))
    return ranked(per.select("conv_id", "q_id", "doc_id", "hits", F.round(score, 6).alias("score")), keep)


def reciprocal_ranks(lists: list[DataFrame], most: int = 10, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists."""
    every = lists[0].select("conv_id", "q_id", "doc_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("conv_id", "q_id", "doc_id", "rank"))
    return ranked(every.groupBy("conv_id", "q_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score")), most)


def quality(hits: DataFrame) -> DataFrame:
    """(top, mean, spread, n) of the scores of each question."""
    return hits.groupBy("conv_id", "q_id").agg(F.max("score").alias("top_score"), F.round(F.avg("score"), 10).alias("avg_score"), F.round(F.max("score") - F.min("score"), 7).alias("score_spread"), F.count("*").alias("n_results"))


def route(top: Column, spread: Column, n: Column, temporal: Column, several: Column) -> Column:
    """The strategy for a question from the quality of its first results."""
    return (
        F.when((top > 0.85) & (spread > 0.3), "direct")
        .when(top < 0.5, "expand")
        .when(temporal & (n >= 3), "temporal_sort")
        .when(several | (spread < 0.15), "multi_round")
        .otherwise("direct")
    )


def rounds(hits: DataFrame, docs: DataFrame, questions: DataFrame, size: int = 5, most: int = 3, enough: float = 0.7) -> DataFrame:
    """(conv_id, q_id, rounds, confidence, n_docs): results in rounds of ``size``, each without what was seen, until the question's words are covered.

    With one wording and one ranking a round that leaves out what was seen is the next ``size`` ranks, so all rounds come from
    one retrieval: a word is covered from the first round on in which a result holds it. Questions without results give no row.
    """
    round_of = F.floor((F.col("rank") - 1) / size).cast("int") + 1
    wanted = questions.select("conv_id", "q_id", F.explode(F.array_distinct("tokens")).alias("term"))
    held = hits.select("conv_id", "q_id", "doc_id", round_of.alias("r")).join(docs.select("conv_id", "doc_id", "tokens"), ["conv_id", "doc_id"]).select("conv_id", "q_id", "r", F.explode(F.array_distinct("tokens")).alias("term"))
    first = wanted.join(held, ["conv_id", "q_id", "term"], "left").groupBy("conv_id", "q_id", "term").agg(F.min("r").alias("r"))
    shares = [F.round(F.sum((F.col("r") <= k).cast("int")) / F.count("*"), 6).alias(f"c{k}") for k in range(1, most + 1)]
    covered = first.groupBy("conv_id", "q_id").agg(*shares)
    seen = hits.groupBy("conv_id", "q_id").agg(F.count("*").alias("n"), F.max(round_of).alias("last"))
    both = seen.join(covered, ["conv_id", "q_id"])
    stop = F.lit(most)
    for k in range(most, 0, -1):
        stop = F.when(F.col(f"c{k}") >= enough, F.lit(k)).otherwise(stop)
    done = both.withColumn("rounds", F.least("last", stop))
    at = F.array(*[F.col(f"c{k}") for k in range(1, most + 1)])
    return done.select("conv_id", "q_id", "rounds", F.coalesce(F.element_at(at, F.col("rounds")), F.lit(0.0)).alias("confidence"), F.least("n", F.col("rounds").cast("long") * size).alias("n_docs"))
