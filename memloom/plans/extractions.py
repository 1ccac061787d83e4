"""Queries of extraction, time resolution and reference resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import scoring as C
from memloom.functions import temporal as T
from memloom.functions import text as X
from memloom.operators import extraction as E
from memloom.plans import sqltext as Q
from memloom.plans.texts import artifacts, entries, facts


def x2_rule_artifacts(spark, folder):
    return E.rule_artifacts(entries(spark, folder)).select("entry_id", "obj_type", "content", "src")


def x3_legacy_artifacts(spark, folder):
    e = entries(spark, folder)
    both = F.concat_ws(" ", F.coalesce("user_text", F.lit("")), F.coalesce("assistant_text", F.lit("")))
    words = {"decision": ["decide", "choose", "let's use"], "todo": ["todo", "need to", "should"], "reminder": ["remember", "prefer", "never"]}
    each = F.array(*[F.when(X.contains_any(both, p), F.struct(F.lit(k).alias("obj_type"), F.concat(F.lit(k.capitalize() + " from turn "), F.col("turn_id"), F.lit(": "), F.substring(F.coalesce("user_text", F.lit("")), 1, 100)).alias("content"))) for k, p in words.items()])
    return e.select("entry_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("a")).select("entry_id", "a.*")


def x7_deduplicated(spark, folder):
    a = artifacts(spark, folder)
    first = a.where("not coalesce(context, '') like '[gleaned]%'")
    return E.without_repeats(a.where("context like '[gleaned]%'"), first).select("id")


def x8_time_spans(spark, folder):
    return artifacts(spark, folder).select("id", F.explode(T.spans(F.col("content"))).alias("x")).select("id", "x.*")


def x9_time_artifacts(spark, folder):
    a = E.with_sessions(artifacts(spark, folder)).select("id", "content", "session")
    return E.time_artifacts(a, "content", "session").select("id", "expression", "start", "event_time", "sure")


def x11_session_times(spark, folder):
    return artifacts(spark, folder).where("session_datetime is not null").select("id", F.date_format(T.session_time(F.col("session_datetime")), "yyyy-MM-dd HH:mm").alias("at"))


def x14_resolved_times(spark, folder):
    return E.resolved_times(artifacts(spark, folder))


def c1_keyword_resolution(spark, folder):
    refs = facts(spark, folder).where("test_question is not null").select("conv_id", F.col("fact_id").alias("ref_id"), C.inferred_type(F.col("test_question")).alias("hint"), X.resolver_keywords(F.col("test_question")).alias("words"))
    cands = artifacts(spark, folder).select("conv_id", "id", "obj_type", "turn_id", X.resolver_keywords(F.concat_ws(" ", "content", "quote")).alias("words"))
    return E.resolve_by_keywords(refs, cands)


_U, _A = "coalesce(user_text, '')", "coalesce(assistant_text, '')"
_SPOKEN = f"CASE WHEN {_U} <> '' THEN {_U} ELSE {_A} END"
_RULES = " UNION ALL ".join(
    f"SELECT entry_id, '{k}' AS obj_type, substr({_A if side == 'assistant' else _SPOKEN}, 1, 200) AS content, '{'assistant' if side == 'assistant' else 'user'}' AS src FROM ent WHERE {Q.any_of(_A if side == 'assistant' else f'({_U} || chr(32) || {_A})', p)}"
    for k, (side, p) in S.EXTRACT_TRIGGERS.items()
)
_LEGACY = " UNION ALL ".join(
    f"SELECT entry_id, '{k}' AS obj_type, '{k.capitalize()} from turn ' || turn_id || ': ' || substr({_U}, 1, 100) AS content FROM ent WHERE {Q.any_of(f'({_U} || chr(32) || {_A})', p)}"
    for k, p in {"decision": ["decide", "choose", "let's use"], "todo": ["todo", "need to", "should"], "reminder": ["remember", "prefer", "never"]}.items()
)
_WL = Q.words("lower(content)")
_SESS = r"regexp_extract(lower({c}), '^\s*(\d{{1,2}}):(\d{{2}})\s*(am|pm)\s+on\s+(\d{{1,2}})\s+([a-z]+),?\s+(\d{{4}})', {k})"


def _stamp(c: str) -> str:
    p = [_SESS.format(c=c, k=k) for k in range(1, 7)]
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    full = "['" + "','".join(T.MONTHS) + "']"
    ok = f"(list_contains({full}, {p[4]}) OR list_contains({months}, {p[4]}))"
    return f"CASE WHEN {p[0]} <> '' AND {ok} THEN try_strptime(printf('%04d-%02d-%02d %02d:%02d', {p[5]}::INT, list_position({months}, substr({p[4]}, 1, 3))::INT, {p[3]}::INT, ({p[0]}::INT % 12 + CASE {p[2]} WHEN 'pm' THEN 12 ELSE 0 END)::INT, {p[1]}::INT), '%Y-%m-%d %H:%M') END"


_RESOLVE = f"""WITH {Q.ART}, s AS (SELECT id, event_time_raw, coalesce(max(session_datetime) OVER (PARTITION BY conv_id, turn_id), last_value(session_datetime IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id, id ROWS UNBOUNDED PRECEDING)) AS session FROM art),
k AS (SELECT *, trim(lower(event_time_raw)) AS l FROM s WHERE {Q.any_of('event_time_raw', S.RELATIVE_WORDS)}),
b AS (SELECT *, CASE WHEN session IS NOT NULL THEN {_stamp('session')} END::DATE AS d, TRY_CAST(nullif(regexp_extract(l, '^(\\d+)\\s+(day|week|month|year)s?\\s+ago', 1), '') AS INT) AS n, regexp_extract(l, '^(\\d+)\\s+(day|week|month|year)s?\\s+ago', 2) AS u,
  list_position(['monday','tuesday','wednesday','thursday','friday','saturday','sunday'], nullif(regexp_extract(l, '^last\\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)', 1), '')) AS wd FROM k),
c AS (SELECT *, CASE WHEN wd IS NOT NULL AND wd > 0 THEN -(CASE WHEN ((isodow(d) - wd) % 7 + 7) % 7 = 0 THEN 7 ELSE ((isodow(d) - wd) % 7 + 7) % 7 END) WHEN n IS NOT NULL THEN -n * CASE u WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 365 END
  WHEN l = 'yesterday' THEN -1 WHEN l = 'today' THEN 0 WHEN l = 'tomorrow' THEN 1 WHEN l = 'last week' THEN -7 WHEN l = 'next week' THEN 7 WHEN l = 'last month' THEN -30 WHEN l = 'next month' THEN 30 WHEN l = 'last year' THEN -365 END AS sh FROM b)
SELECT id, event_time_raw, session, CASE WHEN sh IS NOT NULL AND d IS NOT NULL THEN day(d + sh::INT) || ' ' || monthname(d + sh::INT) || ' ' || year(d + sh::INT) END AS event_time FROM c"""
_HINT = "CASE " + " ".join(f"WHEN {Q.any_of('test_question', h)} THEN '{k}'" for k, h in S.TYPE_HINTS.items()) + " END"
QUERIES = {f.__name__: f for f in (x2_rule_artifacts, x3_legacy_artifacts, x7_deduplicated, x8_time_spans, x9_time_artifacts, x11_session_times, x14_resolved_times, c1_keyword_resolution)}
ORACLE = {
    "x2_rule_artifacts": f"WITH {Q.ENTRIES} {_RULES}",
    "x3_legacy_artifacts": f"WITH {Q.ENTRIES} {_LEGACY}",
    "x7_deduplicated": f"WITH {Q.ART}, w AS (SELECT *, list_distinct({_WL}) AS ws FROM art) SELECT id FROM w a WHERE context LIKE '[gleaned]%' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.conv_id = a.conv_id AND b.turn_id = a.turn_id AND NOT coalesce(b.context, '') LIKE '[gleaned]%' AND (lower(a.content) = lower(b.content) OR (least(len(a.ws), len(b.ws)) > 0 AND len(list_intersect(a.ws, b.ws)) / greatest(least(len(a.ws), len(b.ws)), 1)::DOUBLE > 0.8)))",
    "x11_session_times": f"WITH {Q.ART} SELECT id, strftime({_stamp('session_datetime')}, '%Y-%m-%d %H:%M') AS at FROM art WHERE session_datetime IS NOT NULL",
    "x14_resolved_times": _RESOLVE,
    "c1_keyword_resolution": f"""WITH {Q.ART}, {Q.FACTS}, r AS (SELECT conv_id, fact_id AS ref_id, {_HINT} AS hint, list_distinct({Q.plain('test_question', S.RESOLVER_STOPWORDS)}) AS rw FROM fct WHERE test_question IS NOT NULL),
c AS (SELECT conv_id, id, obj_type, turn_id, list_distinct({Q.plain("concat_ws(' ', content, quote)", S.RESOLVER_STOPWORDS)}) AS cw FROM art),
p AS (SELECT r.ref_id, c.id, turn_id, round(least(1.0, CASE WHEN hint = obj_type THEN 0.3 ELSE 0.0 END + CASE WHEN len(rw) > 0 THEN 0.5 * len(list_intersect(rw, cw)) / len(rw) ELSE 0.0 END + 0.1 / (1 + 0.1 * turn_id))::DOUBLE, 6) AS confidence FROM r JOIN c ON c.conv_id = r.conv_id),
b AS (SELECT * FROM p WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY confidence DESC, turn_id, id) = 1)
SELECT r.ref_id, b.id AS resolved_id, b.confidence FROM r LEFT JOIN b ON b.ref_id = r.ref_id""",
}
