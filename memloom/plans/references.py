"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.operators import references as R
from memloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    artifacts, facts = table(spark, folder, "artifacts"), table(spark, folder, "facts")
    relations, removals = table(spark, folder, "fact_relations"), table(spark, folder, "removals")
    refs = R.references(artifacts, "id", ["references_ids", "leads_to", "caused_by"], "artifacts", "artifacts").unionByName(R.references(relations, "rel_id", ["target_id"], "fact_relations", "facts"))
    known = R.parents(artifacts, "id", removals, "artifacts", "artifacts").unionByName(R.parents(facts, "fact_id", removals, "facts", "facts"))
    return R.orphans(refs, known)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.orphan_report(p2_found(spark, folder))


_FOUND = r"""
WITH refs AS (
  SELECT 'artifacts' AS tab, id AS ref_key, f.name AS field_name, unnest(f.ids) AS raw, loaded_at, created_at
  FROM (SELECT id, loaded_at, created_at, unnest([
          {'name': 'references_ids', 'ids': references_ids}, {'name': 'leads_to', 'ids': leads_to}, {'name': 'caused_by', 'ids': caused_by}]) AS f
        FROM artifacts)
  UNION ALL
  SELECT 'fact_relations', rel_id, 'target_id', target_id, loaded_at, created_at FROM fact_relations),
clean AS (
  SELECT tab, ref_key, field_name, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS target_key, min(loaded_at) AS ref_at, min(created_at) AS made
  FROM refs WHERE raw IS NOT NULL GROUP BY ALL),
known AS (
  SELECT 'artifacts' AS tab, id AS k, min(loaded_at) AS first_at FROM artifacts GROUP BY id
  UNION ALL SELECT 'fact_relations', fact_id, min(loaded_at) FROM facts GROUP BY fact_id),
gone AS (
  SELECT DISTINCT CASE tab WHEN 'artifacts' THEN 'artifacts' ELSE 'fact_relations' END AS tab, object_id AS k FROM removals WHERE restored_at IS NULL),
found AS (
  SELECT c.tab, c.ref_key, c.field_name, c.target_key,
    CASE WHEN g.k IS NOT NULL THEN 'deleted' WHEN n.k IS NULL THEN 'missing' WHEN n.first_at > c.ref_at + INTERVAL 7 DAY THEN 'late' END AS kind,
    strftime(c.made, '%Y-%m') AS ref_month
  FROM clean c LEFT JOIN known n ON n.tab = c.tab AND n.k = c.target_key LEFT JOIN gone g ON g.tab = c.tab AND g.k = c.target_key
  WHERE c.target_key <> '')
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _FOUND + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p2_report": _FOUND + "SELECT tab, field_name, kind, ref_month, count(*) AS n_refs FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
