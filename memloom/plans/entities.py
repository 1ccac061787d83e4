"""Queries of model output, entities, the entity graph and reference resolution by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import entities as N
from memloom.functions import scoring as C
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.operators import entity_graph as EG
from memloom.operators import extraction as E
from memloom.plans import sqltext as Q
from memloom.plans.extractions import ORACLE as _EXTRACTED
from memloom.plans.extractions import _HINT, _WL
from memloom.plans.retrieval import _hash
from memloom.plans.texts import artifacts, entries, facts
from memloom.session import materialize


def x5_model_output(spark, folder):
    """Each turn's artifacts as a model would write them, an array with or without a fence, and what is read from that."""
    item = F.struct(F.col("obj_type").alias("type"), "content", F.col("quote").alias("citation"), "context", "confidence", F.col("event_time_raw").alias("time_expression"))
    said = artifacts(spark, folder).groupBy("conv_id", "turn_id").agg(F.to_json(F.collect_list(item)).alias("json"))
    text = F.when(F.col("turn_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "json", F.lit("\n```\n"))).otherwise(F.col("json"))
    return E.parsed(said.withColumn("text", text), "text", ["conv_id", "turn_id"]).select("conv_id", "turn_id", "obj_type", "content", "quote", "confidence", "event_time_raw")


def x6_gleaned(spark, folder):
    a = artifacts(spark, folder).select("conv_id", "turn_id", "id", "content", "context")
    second = F.coalesce(F.col("context"), F.lit("")).startswith("[gleaned]")
    again = a.where(second).withColumn("context", F.trim(F.substring("context", 10, 1 << 30)))
    return E.gleaned(a.where(~second), again).select("id", "context")


def x10_merged_times(spark, folder):
    a = artifacts(spark, folder)
    timed = E.time_artifacts(E.with_sessions(a).select("conv_id", "turn_id", "id", "content", "session"), "content", "session")
    found = timed.select("conv_id", "turn_id", F.concat_ws(":", "id", "start").alias("id"), "expression", "event_time")
    return E.merged_times(a, found).select("id", "event_time", "event_time_raw", "added")


def x15_typed_entities(spark, folder):
    return EG.mentions(entries(spark, folder)).select("entry_id", "name", "type")


def x16_entities(spark, folder):
    return entries(spark, folder).select("entry_id", F.array_join(N.keywords(F.coalesce("user_text", F.lit(""))), "|").alias("entities"))


def w9_entity_nodes(spark, folder):
    return EG.nodes(EG.mentions(entries(spark, folder))).select("conv_id", "name", "type", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


def g21_entity_links(spark, folder):
    return EG.links(EG.mentions(entries(spark, folder)))


def _asked(spark, folder):
    return facts(spark, folder).where("test_question is not null").select("conv_id", F.col("fact_id").alias("q_id"), F.col("test_question").alias("question"))


def _matched(spark, folder):
    m = EG.mentions(entries(spark, folder))
    return materialize(EG.match(EG.nodes(m), _asked(spark, folder)), "matched"), m


def q26_matched_entities(spark, folder):
    return _matched(spark, folder)[0].select("q_id", "name")


def q27_expanded_entities(spark, folder):
    seeds, m = _matched(spark, folder)
    return EG.expand(seeds, EG.links(m)).select("q_id", "name")


def q28_entity_context(spark, folder):
    seeds, m = _matched(spark, folder)
    l = EG.links(m)
    return EG.context(EG.expand(seeds, l), EG.nodes(m), l).select("q_id", "block")


def _references(spark, folder):
    refs = facts(spark, folder).where("test_question is not null")
    q = F.col("test_question")
    refs = refs.select("conv_id", F.col("fact_id").alias("ref_id"), C.inferred_type(q).alias("hint"), X.resolver_keywords(q).alias("words"), V.unit(V.hash_vector(q)).alias("vec"))
    text = F.concat_ws(" ", "content", "quote")
    return refs, artifacts(spark, folder).select("conv_id", "id", "obj_type", "turn_id", X.resolver_keywords(text).alias("words"), V.unit(V.hash_vector(text)).alias("vec"))


def c3_vector_resolution(spark, folder):
    return E.resolve(*_references(spark, folder), "embedding")


def c4_hybrid_resolution(spark, folder):
    return E.resolve(*_references(spark, folder), "hybrid")


def c5_resolved_batch(spark, folder):
    """How many references each strategy resolves, all references of the corpus in one batch."""
    out = None
    for name, found in E.resolve_each(*_references(spark, folder), ["keyword", "embedding", "hybrid"]).items():
        r = found.agg(F.lit(name).alias("strategy"), F.count("*").alias("n"), F.count("resolved_id").alias("resolved"))
        out = r if out is None else out.unionByName(r)
    return out


def e6_aligned_cosines(spark, folder):
    """The cosine of each fact with its conversation's artifacts of the same turn, 0 where a vector is missing or of another length."""
    v = V.hash_vector(F.col("content"))
    f = facts(spark, folder).select("conv_id", "turn_id", "fact_id", F.when(F.col("content").isNotNull(), F.slice(v, 1, F.when(F.col("turn_id") % 5 == 0, 8).otherwise(16))).alias("a"))
    o = artifacts(spark, folder).select("conv_id", "turn_id", "id", F.when(F.col("content").isNotNull(), V.hash_vector(F.col("content"))).alias("b"))
    return f.join(o, ["conv_id", "turn_id"]).select("fact_id", "id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def _list(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}', 1), [])"


def _mentions(text: str) -> str:
    t = f"coalesce({text}, '')"
    low = f"lower({t})"
    numbers = f"list_transform(list_zip({_list(low, N.NUMBER)}, {_list(low, N.UNIT)}), lambda z: z[1] || ' ' || z[2])"
    terms = f"list_filter({_list(t, N.QUOTED)}, lambda q: length(q) BETWEEN 3 AND 49)"
    of = lambda c, k: f"list_transform({c}, lambda x: {{'name': lower(trim(x)), 'type': '{k}'}})"
    return f"list_distinct({of(_list(low, N.TOOL), 'TECHNOLOGY')} || {of(numbers, 'NUMBER')} || {of(_list(t, N.MONEY), 'NUMBER')} || {of(terms, 'CONCEPT')})"


# a word boundary stands between any two letters' ends in Spark, but only between Latin ones in the other engine, so names are split off there
_KNOWN = "[" + Q.quoted(sorted({*N.TECHNOLOGY, *N.MORE_TECHNOLOGY} - {"vue"})) + "]"
_UT = "coalesce(user_text, '')"
_KW = f"list_sort(list_distinct({_list(f'lower({_UT})', N.AMOUNT)} || {_list(f'lower({_UT})', N.MONTH_DAY)} || list_filter({_KNOWN}, lambda t: contains(lower({_UT}), t)) || {_list(_UT, N.MONEY)} || list_transform(list_filter({_list(_UT, N.QUOTED)}, lambda q: length(q) < 50), lambda q: lower(q)) || {_list(f'lower({_UT})', N.MAIL)} || {_list(f'lower({_UT})', N.LINK)} || {_list(f'lower({_UT})', N.PHONE)} || list_filter(list_transform(list_filter(regexp_split_to_array({_UT}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z0-9]+')), lambda w: lower(w)), lambda w: w NOT IN ({Q.quoted(N.NO_NAMES)}))))"
_MEN = f"""WITH RECURSIVE {Q.ENTRIES}, mn AS (SELECT conv_id, entry_id, turn_id, e.name AS name, e.type AS type FROM (SELECT conv_id, entry_id, turn_id, unnest({_mentions("concat_ws(' ', user_text, assistant_text)")}) AS e FROM ent) WHERE e.name <> ''),
nd AS (SELECT conv_id, name, arg_min(type, (turn_id, entry_id, type)) AS type, list_sort(list_distinct(list(turn_id))) AS turns FROM mn GROUP BY 1, 2),
one AS (SELECT DISTINCT conv_id, entry_id, name FROM mn),
lk AS (SELECT a.conv_id, a.name AS a, b.name AS b, count(*) AS n FROM one a JOIN one b ON a.conv_id = b.conv_id AND a.entry_id = b.entry_id AND a.name < b.name GROUP BY ALL)"""
_MATCH = _MEN + f""", {Q.FACTS}, qs AS (SELECT conv_id, fact_id AS q_id, test_question AS question FROM fct WHERE test_question IS NOT NULL),
ask AS (SELECT DISTINCT conv_id, q_id, e.name AS asked FROM (SELECT conv_id, q_id, unnest({_mentions('question')}) AS e FROM qs) WHERE e.name <> ''),
ex AS (SELECT ask.conv_id, q_id, asked, name FROM ask JOIN nd ON nd.conv_id = ask.conv_id AND name = asked),
ix AS (SELECT ask.conv_id, q_id, name FROM ask JOIN nd ON nd.conv_id = ask.conv_id AND (contains(name, asked) OR contains(asked, name)) WHERE (ask.conv_id, q_id, asked) NOT IN (SELECT (conv_id, q_id, asked) FROM ex)),
nm AS (SELECT conv_id, q_id, name FROM ex UNION SELECT * FROM ix),
vs AS (SELECT qs.conv_id, q_id, name, round(list_cosine_similarity({_hash('question')}, {_hash('name')}), 6) AS score FROM qs JOIN nd ON nd.conv_id = qs.conv_id WHERE (qs.conv_id, q_id) NOT IN (SELECT (conv_id, q_id) FROM nm)),
sd AS (SELECT * FROM nm UNION SELECT conv_id, q_id, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q_id ORDER BY score DESC, name) AS r FROM vs) WHERE r <= 5 AND score > 0.3)"""
_EXPAND = _MATCH + """, bi AS (SELECT conv_id, a, b FROM lk UNION SELECT conv_id, b, a FROM lk), h1 AS (SELECT sd.conv_id, q_id, name, b AS node FROM sd JOIN bi ON bi.conv_id = sd.conv_id AND bi.a = sd.name),
h2 AS (SELECT h1.conv_id, q_id, b AS node FROM h1 JOIN bi ON bi.conv_id = h1.conv_id AND bi.a = h1.node),
ev AS (SELECT conv_id, q_id, name FROM sd UNION SELECT conv_id, q_id, node FROM h1 UNION SELECT conv_id, q_id, node FROM h2),
wd AS (SELECT conv_id, q_id FROM ev GROUP BY ALL HAVING count(*) > 15),
sh AS (SELECT conv_id, q_id, name FROM sd UNION SELECT conv_id, q_id, node FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q_id, name ORDER BY node) AS r FROM h1) WHERE r <= 3),
pk AS (SELECT * FROM ev WHERE (conv_id, q_id) NOT IN (SELECT (conv_id, q_id) FROM wd) UNION ALL SELECT * FROM sh WHERE (conv_id, q_id) IN (SELECT (conv_id, q_id) FROM wd))"""
_TEXT = "concat_ws(' ', content, quote)"
_VEC = f"""WITH {Q.ART}, {Q.FACTS}, rv AS (SELECT conv_id, fact_id AS ref_id, {_HINT} AS hint, {_hash('test_question')} AS v FROM fct WHERE test_question IS NOT NULL),
cv AS (SELECT conv_id, id, obj_type, {_hash(_TEXT)} AS v FROM art),
hv AS (SELECT rv.*, EXISTS (SELECT 1 FROM cv WHERE cv.conv_id = rv.conv_id AND cv.obj_type = rv.hint) AS typed FROM rv),
sv AS (SELECT ref_id, id, round(list_cosine_similarity(hv.v, cv.v), 6) AS score FROM hv JOIN cv ON cv.conv_id = hv.conv_id AND (NOT typed OR obj_type = hint)),
bv AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, id) = 1),
res_v AS (SELECT rv.ref_id, CASE WHEN score >= 0.5 THEN bv.id END AS resolved_id, greatest(coalesce(score, 0.0), 0.0) AS confidence FROM rv LEFT JOIN bv ON bv.ref_id = rv.ref_id)"""
_BOTH = _VEC + f", res_k AS ({_EXTRACTED['c1_keyword_resolution']}), res_b AS (SELECT k.ref_id, CASE WHEN k.resolved_id = v.resolved_id THEN k.resolved_id WHEN v.confidence >= coalesce(k.confidence, 0.0) THEN v.resolved_id ELSE k.resolved_id END AS resolved_id, round(CASE WHEN k.resolved_id = v.resolved_id THEN least(1.0, k.confidence + v.confidence) WHEN v.confidence >= coalesce(k.confidence, 0.0) THEN v.confidence ELSE k.confidence END, 6) AS confidence FROM res_k k JOIN res_v v ON v.ref_id = k.ref_id)"
_TYPES = Q.quoted(S.TYPES)
QUERIES = {f.__name__: f for f in (x5_model_output, x6_gleaned, x10_merged_times, x15_typed_entities, x16_entities, w9_entity_nodes, g21_entity_links, q26_matched_entities, q27_expanded_entities, q28_entity_context, c3_vector_resolution, c4_hybrid_resolution, c5_resolved_batch, e6_aligned_cosines)}
ORACLE = {
    "x5_model_output": f"WITH {Q.ART} SELECT conv_id, turn_id, coalesce(obj_type, 'key_fact') AS obj_type, content, coalesce(quote, '') AS quote, coalesce(confidence, 0.8) AS confidence, event_time_raw FROM art WHERE content IS NOT NULL AND coalesce(obj_type, 'key_fact') IN ({_TYPES})",
    "x6_gleaned": f"WITH {Q.ART}, w AS (SELECT *, list_distinct({_WL}) AS ws, starts_with(coalesce(context, ''), '[gleaned]') AS g FROM art) SELECT id, context FROM w WHERE NOT g UNION ALL SELECT id, '[gleaned] ' || trim(substr(context, 10)) FROM w a WHERE g AND NOT EXISTS (SELECT 1 FROM w b WHERE b.conv_id = a.conv_id AND b.turn_id = a.turn_id AND NOT b.g AND (lower(a.content) = lower(b.content) OR (least(len(a.ws), len(b.ws)) > 0 AND len(list_intersect(a.ws, b.ws)) / greatest(least(len(a.ws), len(b.ws)), 1)::DOUBLE > 0.8)))",
    "x15_typed_entities": _MEN + " SELECT entry_id, name, type FROM mn",
    "x16_entities": f"WITH {Q.ENTRIES} SELECT entry_id, array_to_string({_KW}, '|') AS entities FROM ent",
    "w9_entity_nodes": _MEN + " SELECT conv_id, name, type, array_to_string(turns, ',') AS turns FROM nd",
    "g21_entity_links": _MEN + " SELECT * FROM lk",
    "q26_matched_entities": _MATCH + " SELECT q_id, name FROM sd",
    "q27_expanded_entities": _EXPAND + " SELECT q_id, name FROM pk",
    "q28_entity_context": _EXPAND + ", ty AS (SELECT pk.conv_id, q_id, type, '### ' || type || chr(10) || string_agg('- **' || pk.name || '** (from turns: ' || array_to_string(turns, ', ') || ')', chr(10) ORDER BY '- **' || pk.name || '** (from turns: ' || array_to_string(turns, ', ') || ')') AS part FROM pk JOIN nd ON nd.conv_id = pk.conv_id AND nd.name = pk.name GROUP BY pk.conv_id, q_id, type), pt AS (SELECT conv_id, q_id, string_agg(part, chr(10) || chr(10) ORDER BY part) AS nodes FROM ty GROUP BY conv_id, q_id), tl AS (SELECT x.conv_id, x.q_id, string_agg('- ' || a || ' --[related_to]--> ' || b, chr(10) ORDER BY '- ' || a || ' --[related_to]--> ' || b) AS links FROM pk x JOIN lk ON lk.conv_id = x.conv_id AND lk.a = x.name JOIN pk y ON y.conv_id = x.conv_id AND y.q_id = x.q_id AND y.name = lk.b GROUP BY x.conv_id, x.q_id) SELECT pt.q_id, nodes || CASE WHEN links IS NOT NULL THEN chr(10) || chr(10) || '### Relationships' || chr(10) || links ELSE '' END AS block FROM pt LEFT JOIN tl ON tl.conv_id = pt.conv_id AND tl.q_id = pt.q_id",
    "c3_vector_resolution": _VEC + " SELECT * FROM res_v",
    "c4_hybrid_resolution": _BOTH + " SELECT * FROM res_b",
    "c5_resolved_batch": _BOTH + " SELECT 'keyword' AS strategy, count(*) AS n, count(resolved_id) AS resolved FROM res_k UNION ALL SELECT 'embedding', count(*), count(resolved_id) FROM res_v UNION ALL SELECT 'hybrid', count(*), count(resolved_id) FROM res_b",
    "e6_aligned_cosines": f"WITH {Q.ART}, {Q.FACTS} SELECT fact_id, id, CASE WHEN fct.content IS NULL OR art.content IS NULL OR fct.turn_id % 5 = 0 THEN 0.0 ELSE round(list_cosine_similarity({_hash('fct.content')}, {_hash('art.content')}), 6) END AS cosine FROM fct JOIN art ON art.conv_id = fct.conv_id AND art.turn_id = fct.turn_id",
}
