"""Queries that derive questions and evidence, and parse extracted artifacts out of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import text as X
from memloom.plans import sqltext as Q
from memloom.plans.texts import entries, facts
from memloom.sources.tables import once, table


def a3_preference_questions(spark, folder):
    """Turns in which the user changes a preference."""
    hit = X.contains_any(F.col("user_text"), ["prefer", "actually", "how about"])
    return entries(spark, folder).where(hit).select("conv_id", "entry_id", F.lit("At what point did the user change their preference?").alias("question"), F.concat(F.lit("Turn "), F.col("turn_id")).alias("answer"))


def a4_evidence_turns(spark, folder):
    """The entry of each fact's turn, -1 where there is none."""
    first = entries(spark, folder).groupBy("conv_id", "turn_id").agg(F.min("entry_id").alias("entry_id"))
    return facts(spark, folder).select("fact_id", "conv_id", "turn_id").join(first, ["conv_id", "turn_id"], "left").select("fact_id", F.coalesce("entry_id", F.lit(-1)).alias("entry_id"))


def d4_multihop_questions(spark, folder):
    """A question over each relation between two known facts; ids compare without white space, in lower case."""
    r = once(table(spark, folder, "fact_relations"), "rel_id", order=("loaded_at",))
    f = facts(spark, folder)
    source = f.select(F.col("fact_id").alias("source_id"), F.col("content").alias("a"))
    target = f.select(F.col("fact_id").alias("t"), F.col("content").alias("b"))
    clean = F.lower(F.regexp_replace("target_id", r"(?U)^\s+|\s+$", ""))
    both = r.withColumn("t", clean).join(source, "source_id").join(target, "t")
    asks = F.when(F.col("relation_type") == "caused_by", F.concat(F.lit("Why: "), "a")).otherwise(F.concat(F.lit("What follows from: "), "a"))
    return both.select("rel_id", asks.alias("question"), F.col("b").alias("answer"), F.lit(2).alias("hops"))


def x5_parsed_artifacts(spark, folder):
    """Artifacts written as JSON lines in documents: unknown types drop out, a missing type is key_fact, a missing confidence 0.8."""
    line = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line")).where(F.col("line").startswith('{"id"'))
    r = line.select("doc_id", F.from_json("line", "id string, type string, content string, turn_id int, confidence double").alias("r")).select("doc_id", "r.*")
    kind = F.coalesce("type", F.lit("key_fact"))
    return r.where(F.col("content").isNotNull() & kind.isin(S.TYPES)).select("doc_id", "id", kind.alias("obj_type"), "content", F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


QUERIES = {f.__name__: f for f in (a3_preference_questions, a4_evidence_turns, d4_multihop_questions, x5_parsed_artifacts)}
ORACLE = {
    "a3_preference_questions": f"WITH {Q.ENTRIES} SELECT conv_id, entry_id, 'At what point did the user change their preference?' AS question, 'Turn ' || turn_id AS answer FROM ent WHERE {Q.any_of('user_text', ['prefer', 'actually', 'how about'])}",
    "a4_evidence_turns": f"WITH {Q.ENTRIES}, {Q.FACTS}, g AS (SELECT conv_id, turn_id, min(entry_id) AS e FROM ent GROUP BY 1, 2) SELECT fact_id, coalesce(e, -1) AS entry_id FROM fct LEFT JOIN g ON g.conv_id = fct.conv_id AND g.turn_id = fct.turn_id",
    "d4_multihop_questions": f"WITH {Q.FACTS}, r AS (SELECT * FROM fact_relations QUALIFY row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at) = 1) SELECT rel_id, CASE WHEN relation_type = 'caused_by' THEN 'Why: ' || a.content ELSE 'What follows from: ' || a.content END AS question, b.content AS answer, 2 AS hops FROM r JOIN fct a ON a.fact_id = r.source_id JOIN fct b ON b.fact_id = lower(regexp_replace(r.target_id, '^\\s+|\\s+$', '', 'g'))",
    "x5_parsed_artifacts": "WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM documents WHERE text IS NOT NULL), j AS (SELECT doc_id, line AS j FROM l WHERE starts_with(line, '{\"id\"') AND json_valid(line)) SELECT doc_id, j->>'$.id' AS id, coalesce(j->>'$.type', 'key_fact') AS obj_type, j->>'$.content' AS content, coalesce(TRY_CAST(j->>'$.confidence' AS DOUBLE), 0.8) AS confidence FROM j WHERE j->>'$.content' IS NOT NULL AND coalesce(j->>'$.type', 'key_fact') IN (" + Q.quoted(S.TYPES) + ")",
}
