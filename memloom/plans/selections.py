"""Queries of budgeted selection, injection and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom import schema as S
from memloom.operators import graph as G
from memloom.operators import selection as P
from memloom.plans import sqltext as Q
from memloom.plans.texts import artifacts


def v1_object_scores(spark, folder):
    return P.scored(artifacts(spark, folder)).select("id", F.round("omega", 6).alias("omega"), F.round("rho", 6).alias("rho"), F.round("delta", 6).alias("delta"))


def v3_prioritised(spark, folder):
    return P.prioritised(P.scored(artifacts(spark, folder))).select("id", "rank")


def v3_prioritised_by_confidence(spark, folder):
    return P.prioritised(P.scored(artifacts(spark, folder), "confidence"), 5).select("id", "rank")


def v7_retention_bound(spark, folder):
    return P.retention_bound(P.scored(artifacts(spark, folder)))


def v5_chain_selection(spark, folder):
    a = artifacts(spark, folder)
    starts = a.where("obj_type = 'decision'").select("conv_id", F.col("id").alias("start"))
    chains = G.walk(G.mirrored(G.edges(a)).where("relation = 'caused_by'"), starts, 3)
    return P.chain_selection(P.scored(a), chains)


def i2_budget_prefix(spark, folder):
    return P.within_budget(P.injection_order(artifacts(spark, folder), "confidence"), 500, markdown=True).select("id", "rn", "cost", "used")


def i3_inject_compact(spark, folder):
    return P.rendered(P.within_budget(P.injection_order(artifacts(spark, folder), "recency"), 300))


def i3_inject_markdown(spark, folder):
    return P.rendered(P.within_budget(P.injection_order(artifacts(spark, folder), "confidence"), 300, markdown=True), "markdown")


def i4_injection_tokens(spark, folder):
    return i3_inject_compact(spark, folder).select("conv_id", F.floor(F.length("block") / 4).cast("long").alias("tokens"))


def i5_stats(spark, folder):
    return P.statistics(artifacts(spark, folder))


_W = "CASE obj_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.IMPORTANCE.items()) + " ELSE 0.5 END"
_RHO = f"greatest(0.0, least(1.0, 0.1::DOUBLE + 0.8 * CASE WHEN total <= 0 THEN 1.0 ELSE turn_id / total::DOUBLE END + CASE WHEN coalesce(regexp_matches(content, '[0-9]'), false) THEN 0.1 ELSE 0.0 END + CASE WHEN coalesce(list_bool_or(list_transform({Q.words('content')}, lambda x, i: i > 1 AND regexp_matches(x, '^\\p{{Lu}}'))), false) THEN 0.1 ELSE 0.0 END - CASE WHEN length(content) > 200 THEN 0.05 ELSE 0.0 END))"
_S = f"""WITH {Q.ART}, t AS (SELECT *, max(turn_id) OVER (PARTITION BY conv_id) AS total FROM art),
s0 AS (SELECT *, round(@omega@, 9) AS omega, round(({_RHO})::DOUBLE, 9) AS rho FROM t), s1 AS (SELECT *, round(omega * (1 - rho), 9) AS delta FROM s0),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY delta DESC, turn_id, id) AS rank FROM s1)"""
_H = _S.replace("@omega@", f"(({_W}) * coalesce(confidence, 0.0))::DOUBLE")
_C = _S.replace("@omega@", "coalesce(confidence, 0.0)")


def _budget(order: str, budget: int, markdown: bool) -> str:
    quote = "|| substr(coalesce(quote, ''), 1, 150)" if markdown else ""
    return f"""WITH {Q.ART}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}, id) AS rn, length(coalesce(content, '') {quote}) // 4 + 10 AS cost FROM art),
b AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY rn) AS used FROM o), k AS (SELECT * FROM b WHERE used <= {budget - (20 if markdown else 5)})"""


_DATED = "CASE WHEN event_time_raw IS NOT NULL THEN '**' || event_time_raw || '**: ' ELSE '' END"
_COMPACT = _budget("turn_id DESC", 300, False) + f", c AS (SELECT conv_id, string_agg('[' || upper(substr(obj_type, 1, 1)) || '] ' || {_DATED} || coalesce(content, ''), chr(10) ORDER BY rn) AS block FROM k GROUP BY 1)"
_LABEL = "CASE obj_type " + " ".join(f"WHEN '{t}' THEN '{t.replace('_', ' ').title()}'" for t in S.TYPES) + " END"
_MARK = _budget("confidence DESC NULLS LAST", 300, True) + f""" SELECT conv_id, '## Relevant Context from This Conversation' || chr(10) || chr(10) || string_agg('- **[' || {_LABEL} || ']** ' || {_DATED} || coalesce(content, '') ||
CASE WHEN coalesce(quote, '') <> '' THEN chr(10) || '  > "' || CASE WHEN length(quote) > 150 THEN substr(quote, 1, 150) || '...' ELSE quote END || '"' ELSE '' END, chr(10) ORDER BY rn) AS block FROM k GROUP BY 1"""

QUERIES = {f.__name__: f for f in (v1_object_scores, v3_prioritised, v3_prioritised_by_confidence, v5_chain_selection, v7_retention_bound, i2_budget_prefix, i3_inject_compact, i3_inject_markdown, i4_injection_tokens, i5_stats)}
ORACLE = {
    "v1_object_scores": _H + " SELECT id, round(omega, 6) AS omega, round(rho, 6) AS rho, round(delta, 6) AS delta FROM s",
    "v3_prioritised": _H + " SELECT id, rank FROM s WHERE rank <= 10",
    "v3_prioritised_by_confidence": _C + " SELECT id, rank FROM s WHERE rank <= 5",
    "v7_retention_bound": _H + " SELECT conv_id, round(sum(omega * rho), 6) AS naturally, round(sum(CASE WHEN rank <= 10 THEN delta ELSE 0.0 END), 6) AS gained, round(sum(omega * rho) + sum(CASE WHEN rank <= 10 THEN delta ELSE 0.0 END), 6) AS total FROM s GROUP BY 1",
    "i2_budget_prefix": _budget("confidence DESC NULLS LAST", 500, True) + " SELECT id, rn, cost, used FROM k",
    "i3_inject_compact": _COMPACT + " SELECT * FROM c",
    "i3_inject_markdown": _MARK,
    "i4_injection_tokens": _COMPACT + " SELECT conv_id, length(block) // 4 AS tokens FROM c",
    "i5_stats": f"WITH {Q.ART} SELECT conv_id, count(*) AS total, max(turn_id) AS turns, round(coalesce(avg(confidence), 0.0), 6) AS avg_confidence, " + ", ".join(f"count(*) FILTER (WHERE obj_type = '{t}') AS n_{t}" for t in S.TYPES) + " FROM art GROUP BY 1",
}
