"""Queries of the training-data operators, and their SQL where it can run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import endings, near_duplicates, neighbours, packing, pairs, residue, splitting, tokens
from memloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, folder, "artifacts"), "id", ["content", "quote"])


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, folder, "artifacts"), "id", ["content", "quote"])


_P1 = r"""
WITH words AS (
  SELECT id, list_distinct(regexp_extract_all(lower(coalesce(content, '') || ' ' || coalesce(quote, '')), '[\p{L}\p{N}]+')) AS w
  FROM (SELECT id, any_value(content) AS content, any_value(quote) AS quote FROM artifacts GROUP BY id)),
big AS (SELECT id, len(w) AS n, w FROM words WHERE len(w) >= 24),
tokens AS (SELECT id, n, unnest(w) AS t FROM big),
pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM pairs WHERE 10 * shared >= 7 * (na + nb - shared)
"""


_P1_CLASSES = r"""
WITH RECURSIVE words AS (
  SELECT id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(content, '') || ' ' || coalesce(quote, '')), '[\p{L}\p{N}]+'))) AS w
  FROM (SELECT id, any_value(content) AS content, any_value(quote) AS quote FROM artifacts GROUP BY id)),
big AS (SELECT id, len(w) AS n, w, min(id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS copies FROM words WHERE len(w) >= 24),
tokens AS (SELECT id, n, unnest(w) AS t FROM big WHERE id = class_id),
pairs AS (
  SELECT a.id AS x, b.id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.id <> b.id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 10 * shared >= 7 * (na + nb - shared)),
reach AS (SELECT class_id AS x, class_id AS y FROM big UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x, min(y) AS group_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS links FROM links GROUP BY x)
SELECT id, class_id, copies, coalesce(links, 0) AS links, group_id
FROM big JOIN groups ON groups.x = class_id LEFT JOIN degree ON degree.x = class_id
"""


def _p3(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(table(spark, folder, "chunks"), "chunk_id", "content", "source_turns")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p3(spark, folder).where("piece = 0").select(F.col("key").alias("chunk_id"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _p3(spark, folder).withColumnsRenamed({"key": "chunk_id", "start": "start_char", "end": "end_char"})


_P4_TABLES = (("chunks", "chunk_id"), ("archive_entries", "entry_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [neighbours.mutual_pairs(neighbours.near(table(spark, folder, tab), key, "embedding", 0.9)).select(F.lit(tab).alias("tab"), "id_a", "id_b") for tab, key in _P4_TABLES]
    return found[0].unionByName(found[1])


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    lists = [neighbours.nearest(table(spark, folder, tab), key, "embedding", queries=F.col(key) % 20 == 0).select(F.lit(tab).alias("tab"), F.col("key").alias("id"), F.posexplode("neighbours").alias("rank", "x")) for tab, key in _P4_TABLES]
    return lists[0].unionByName(lists[1]).select("tab", "id", "rank", F.col("x.id").alias("neighbour_id"), F.round("x.cosine", 4).alias("cosine"))


def _p5(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pair_defects(pairs.as_pairs(table(spark, folder, "fact_results"), table(spark, folder, "agent_responses")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return _p5(spark, folder).groupBy("tab", "field_name", "defect").agg(F.count("*").alias("n_pairs"))


def _p6(spark: SparkSession, folder: str) -> DataFrame:
    results, artifacts = table(spark, folder, "fact_results"), table(spark, folder, "artifacts")
    said = results.select(F.lit("fact_results").alias("tab"), F.col("result_id").cast("string").alias("rec_key"), F.lit("answer").alias("field_name"), F.col("agent_name").alias("source"), F.col("answer").alias("text"))
    quoted = artifacts.select(F.lit("artifacts").alias("tab"), F.col("id").alias("rec_key"), F.lit("quote").alias("field_name"), F.col("src").alias("source"), F.col("quote").alias("text"))
    return endings.endings(said.unionByName(quoted).where("text is not null"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p6(spark, folder).where("cut").select("tab", "rec_key", "field_name")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    return endings.cut_rates(_p6(spark, folder))


def p6_deciders(spark: SparkSession, folder: str) -> DataFrame:
    return endings.deciders(_p6(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    texts = tokens.decode(tokens.encode(documents, "doc_id", "text")).withColumnRenamed("key", "doc_id")
    same = F.coalesce(documents["text"], F.lit("")) == texts["text"]
    return documents.join(texts, "doc_id").agg(F.count("*").alias("n_documents"), F.sum(same.cast("long")).alias("n_equal"))


def _p8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, folder, "documents")))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _p8(spark, folder).withColumnRenamed("key", "doc_id")


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    return packing.bins(_p8(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents")).select("doc_id")


def p9_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Classified messages by whole message: documents, sources, and whether they are left out."""
    found = residue.residue_messages(residue.hashed_messages(table(spark, folder, "documents")))
    return found.groupBy("kind", "message").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.max(F.col("by_message") | F.col("by_core")).alias("residue"))


_P4 = """
WITH v AS (
  SELECT 'chunks' AS tab, chunk_id AS id, any_value(embedding) AS e FROM chunks GROUP BY chunk_id
  UNION ALL SELECT 'archive_entries', entry_id, any_value(embedding) FROM archive_entries GROUP BY entry_id),
u AS (
  SELECT tab, id, e::FLOAT[128] AS e FROM v
  WHERE e IS NOT NULL AND len(e) = 128 AND NOT list_bool_or(list_transform(e, lambda x: isnan(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
s AS (
  SELECT a.tab, a.id AS a, b.id AS b, array_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.tab = b.tab AND a.id <> b.id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY tab, a ORDER BY round(c, 6) DESC, b) <= 10)
SELECT x.tab, x.a AS id_a, x.b AS id_b FROM t x JOIN t y ON x.tab = y.tab AND x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.c >= 0.9
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p6_deciders": p6_deciders,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_pack": p8_pack,
    "p8_bins": p8_bins,
    "p9_found": p9_found,
    "p9_messages": p9_messages,
}
ORACLE = {
    "p1_found": _P1,
    "p1_classes": _P1_CLASSES,
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 512",
    "p7_round_trip": "SELECT count(*) AS n_documents, count(*) AS n_equal FROM documents",
    "p4_found": _P4,
}
