"""Queries of turns, compaction windows, chunks and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import turns as W
from memloom.plans import sqltext as Q
from memloom.plans.retrieval import _hash
from memloom.plans.texts import artifacts, entries
from memloom.sources.tables import table


def w1_turns(spark, folder):
    return W.turns(W.messages(entries(spark, folder)))


def w3_phases(spark, folder):
    return W.phases(entries(spark, folder), 10, 3)


def w4_windows(spark, folder):
    return W.windows(entries(spark, folder), table(spark, folder, "sessions"))


def w2_duologue(spark, folder):
    return W.duologue(W.messages(entries(spark, folder)), 4)


def w5_should_compress(spark, folder):
    return W.should_compress(entries(spark, folder), artifacts(spark, folder)).select("entry_id", "turn", "compress", "reason")


def w6_forgotten_turns(spark, folder):
    return w4_windows(spark, folder).where("not kept").select("conv_id", "entry_id")


def w7_chunk_walk(spark, folder):
    walked = W.chunk_walk(entries(spark, folder).where("conv_id is not null"))
    return walked.select("conv_id", "chunk", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "text", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


def w8_postings(spark, folder):
    return W.postings(entries(spark, folder))


def x13_batches(spark, folder):
    return W.batches(entries(spark, folder), 5)


_MSG = f"""WITH {Q.ENTRIES}, m0 AS (SELECT conv_id, turn_id, entry_id, 0 AS side, 'user' AS role, user_text AS text FROM ent UNION ALL SELECT conv_id, turn_id, entry_id, 1, 'assistant', assistant_text FROM ent),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, entry_id, side) AS seq FROM m0 WHERE trim(coalesce(text, ''), ' ') <> ''),
b AS (SELECT *, role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY seq), 'assistant') = 'assistant' AS begins FROM m),
t AS (SELECT *, greatest(sum(begins::INT) OVER (PARTITION BY conv_id ORDER BY seq), 1)::INT AS turn FROM b)"""
_WIN = f"""WITH {Q.ENTRIES}, z AS (SELECT conv_id, max(compact_every) AS every FROM sessions GROUP BY 1),
n AS (SELECT ent.conv_id, entry_id, row_number() OVER (PARTITION BY ent.conv_id ORDER BY turn_id, entry_id) AS n, every FROM ent LEFT JOIN z ON z.conv_id = ent.conv_id),
b AS (SELECT *, ((n - 1) // coalesce(every, 40))::INT AS bucket FROM n), k AS (SELECT conv_id, entry_id, n, bucket, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY n DESC) <= 5 AS kept FROM b)"""
def _chunk_end(start: str) -> str:
    """Where a chunk ends that begins at ``start``: after the last line end of its last fifth."""
    full = f"least({start} + 512, length(txt))"
    tail = f"substr(txt, greatest({start}, {full} - 102) + 1, {full} - greatest({start}, {full} - 102))"
    return f"CASE WHEN {full} < length(txt) AND contains({tail}, chr(10)) THEN {full} - position(chr(10) IN reverse({tail})) + 1 ELSE {full} END"


QUERIES = {f.__name__: f for f in (w1_turns, w2_duologue, w3_phases, w4_windows, w5_should_compress, w6_forgotten_turns, w7_chunk_walk, w8_postings, x13_batches)}
ORACLE = {
    "w1_turns": _MSG + " SELECT conv_id, turn, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE role = 'user'), '[Continued]') AS user, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE role = 'assistant'), '[No response]') AS assistant FROM t GROUP BY 1, 2",
    "w3_phases": f"WITH {Q.ENTRIES} SELECT conv_id, entry_id, CASE WHEN n > 10 THEN 'live' WHEN n > 7 THEN 'retained' ELSE 'compressed' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, entry_id) AS n FROM ent)",
    "w4_windows": _WIN + " SELECT * FROM k",
    "w2_duologue": _MSG + ", d AS (SELECT *, sum(CASE WHEN role = 'user' AND p = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq) + 1 AS dt FROM (SELECT conv_id, seq, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY seq) AS p FROM m)), l AS (SELECT conv_id, max(dt) AS last FROM d GROUP BY 1 HAVING count(*) >= 4) SELECT d.conv_id, dt::INT AS turn, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE role = 'user'), CASE WHEN dt = any_value(last) THEN '[Continued]' ELSE '[Start]' END) AS user, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE role = 'assistant'), '[End]') AS assistant FROM d JOIN l ON l.conv_id = d.conv_id GROUP BY d.conv_id, dt",
    "w5_should_compress": f"""WITH {Q.ENTRIES}, {Q.ART}, n AS (SELECT conv_id, entry_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, entry_id) - 1 AS turn, {_hash("concat_ws(' ', coalesce(user_text, ''), coalesce(assistant_text, ''))")} AS v FROM ent),
u AS (SELECT conv_id, entry_id, turn, unnest(range(16)) AS d, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x FROM n),
m AS (SELECT *, avg(x) OVER (PARTITION BY conv_id, d ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r, avg(x) OVER (PARTITION BY conv_id, d ORDER BY turn ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS p FROM u),
a AS (SELECT conv_id, entry_id, turn, CASE WHEN turn >= 14 THEN round(coalesce(sum(r * p) / nullif(sqrt(sum(r * r)) * sqrt(sum(p * p)), 0), 0.0), 6) END AS alike FROM m GROUP BY conv_id, entry_id, turn),
k AS (SELECT a.*, (SELECT count(*) FROM art WHERE art.conv_id = a.conv_id AND art.turn_id BETWEEN a.turn - 10 AND a.turn) AS made FROM a),
z AS (SELECT entry_id, turn::INT AS turn, CASE WHEN turn < 20 THEN 'too_soon' WHEN turn >= 60 THEN 'turn_limit' WHEN alike < 0.55 THEN 'topic_shift' WHEN made / 10.0 < 0.5 THEN 'low_density' ELSE 'none' END AS reason FROM k)
SELECT *, reason NOT IN ('too_soon', 'none') AS compress FROM z""",
    "w6_forgotten_turns": _WIN + " SELECT conv_id, entry_id FROM k WHERE NOT kept",
    "w7_chunk_walk": f"""WITH RECURSIVE {Q.ENTRIES}, l AS (SELECT conv_id, turn_id, entry_id, '[Turn ' || turn_id || '] User: ' || coalesce(user_text, '') || chr(10) || 'Assistant: ' || coalesce(assistant_text, '') || chr(10) || chr(10) AS line FROM ent WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn_id, entry_id, sum(length(line)) OVER w - length(line) AS a, sum(length(line)) OVER w AS b FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id, entry_id)),
t AS (SELECT conv_id, string_agg(line, '' ORDER BY turn_id, entry_id) AS txt FROM l GROUP BY 1),
w AS (SELECT conv_id, 0 AS chunk, 0::BIGINT AS start_char, @end0@ AS end_char FROM t
  UNION ALL SELECT w.conv_id, chunk + 1, nx, @end1@ FROM (SELECT *, CASE WHEN end_char - 100 <= 0 THEN end_char ELSE end_char - 100 END AS nx FROM w) w JOIN t ON t.conv_id = w.conv_id WHERE end_char < length(txt))
SELECT w.conv_id, chunk, start_char::INT AS start_char, end_char::INT AS end_char, substr(txt, start_char + 1, end_char - start_char) AS text, (SELECT string_agg(turn_id, ',' ORDER BY turn_id, entry_id) FROM s WHERE s.conv_id = w.conv_id AND b > start_char AND a < end_char) AS turns FROM w JOIN t ON t.conv_id = w.conv_id""".replace("@end0@", _chunk_end("0")).replace("@end1@", _chunk_end("nx")),
    "w8_postings": f"WITH {Q.ENTRIES}, w AS (SELECT DISTINCT conv_id, entry_id, lower(trim(k)) AS keyword FROM (SELECT conv_id, entry_id, unnest(keywords) AS k FROM ent)) SELECT conv_id, keyword, count(*) AS n_entries, min(entry_id) AS first_entry FROM w WHERE keyword <> '' GROUP BY 1, 2",
    "x13_batches": f"WITH {Q.ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id, entry_id) AS n FROM ent) SELECT conv_id, ((n - 1) // 5)::INT AS batch, string_agg('[Turn ' || turn_id || '] User: ' || coalesce(user_text, '') || chr(10) || 'Assistant: ' || coalesce(assistant_text, ''), chr(10) || chr(10) ORDER BY n) AS text, count(*) AS n FROM n GROUP BY 1, 2",
}
