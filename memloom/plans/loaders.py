"""Queries of conversation files, generators, derived questions and renderings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.operators import graph as G
from memloom.operators import learning as L
from memloom.operators import selection as P
from memloom.plans import sqltext as Q
from memloom.plans.graphs import _EDGES
from memloom.plans.metrics import _SC, _scored
from memloom.plans.selections import _H, _budget
from memloom.plans.texts import artifacts, entries, facts
from memloom.session import shared_dir
from memloom.sources import conversations as J
from memloom.sources import generators as D
from memloom.sources.tables import table

_PART = 20  # turns of a conversation that stand in one object of a file


def _path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/memloom/{label}-{uuid.uuid4().hex}"


def s8_flattened_sessions(spark, folder):
    """Turns written as sessions of five turns, read back and flattened."""
    e = entries(spark, folder)
    each = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(n).alias("speaker"), F.coalesce(c, F.lit("")).alias("text")) for k, (n, c) in enumerate((("user", "user_text"), ("assistant", "assistant_text")))])
    lines = e.select(F.concat_ws("#", "conv_id", F.floor(F.col("turn_id") / _PART)).alias("conv_id"), F.floor(F.col("turn_id") / 5).alias("session"), "entry_id", F.explode(each).alias("l"))
    rows = lines.select("conv_id", "session", (F.col("entry_id") * 2 + F.col("l.side")).alias("pos"), "l.speaker", "l.text", F.concat(F.lit("D"), "entry_id", F.lit(":"), "l.side").alias("dia_id"), F.concat(F.lit("day "), "session").alias("session_datetime"))
    path = _path(spark, "sessions")
    J.as_sessions(rows).write.text(path)
    return J.flattened(J.load_sessions(spark, path)).select("conv_id", "session", "role", "text", "dia_id", "session_datetime")


def s9_either_format(spark, folder):
    """The same rows from a file of lines and from one of arrays."""
    s = table(spark, folder, "sessions").dropDuplicates(["conv_id"]).select("conv_id", "title", "agent_name")
    row = F.struct("conv_id", "title", "agent_name")
    lines, arrays = _path(spark, "lines"), _path(spark, "arrays")
    s.select(F.to_json(row)).write.text(lines)
    s.groupBy("agent_name", F.pmod(F.hash("conv_id"), F.lit(64))).agg(F.to_json(F.collect_list(row)).alias("j")).select("j").write.text(arrays)
    schema = "conv_id string, title string, agent_name string"
    return J.load_either(spark, lines, schema).withColumn("form", F.lit("lines")).unionByName(J.load_either(spark, arrays, schema).withColumn("form", F.lit("arrays")))


def s10_dataset_round_trip(spark, folder):
    path = _path(spark, "dataset")
    J.nested(facts(spark, folder), F.concat_ws("#", "conv_id", F.floor(F.col("turn_id") / _PART))).write.text(path)
    return J.load_nested(spark, path).select("id", "n_facts", "fact_id", "turn_id", "content", "ground_truth", F.size("distractors").alias("n_distractors"))


def s13_result_files(spark, folder):
    return J.results_json(_scored(spark, folder))


def s14_saved_model(spark, folder):
    """A fitted model saved and loaded gives the same predictions."""
    from pyspark.ml import PipelineModel

    from memloom.plans.metrics import m1_loss_features
    from memloom.plans.storage import _FEATURES

    rows = m1_loss_features(spark, folder).na.fill(0)
    model, path = L.fit_loss(rows, _FEATURES, "was_lost"), _path(spark, "model")
    model.write().save(path)
    a = model.transform(rows).select("fact_id", F.col("probability").cast("string").alias("a"))
    b = PipelineModel.load(path).transform(rows).select("fact_id", F.col("probability").cast("string").alias("b"))
    return a.join(b, "fact_id").select("fact_id", (F.col("a") == F.col("b")).alias("same"))


def f24_listed_questions(spark, folder):
    """Questions that a model lists, as a JSON array within its words or a line each."""
    said = F.when(F.col("turn_id") % 2 == 0, F.concat(F.lit("Sure: "), F.to_json("distractors"), F.lit(" That is all."))).otherwise(F.array_join("distractors", "\n"))
    return facts(spark, folder).select("fact_id", F.explode(X.listed(said)).alias("item"))


def i1_injection_orders(spark, folder):
    a = artifacts(spark, folder)
    rows = [P.injection_order(a, s).select(F.lit(s).alias("strategy"), "id", "rn") for s in ("confidence", "recency")]
    given = P.injection_order(P.prioritised(P.scored(a)), "relevance").select(F.lit("relevance").alias("strategy"), "id", "rn")
    return rows[0].unionByName(rows[1]).unionByName(given)


def i3_inject_json(spark, folder):
    return P.rendered_json(P.within_budget(P.injection_order(artifacts(spark, folder), "recency"), 300))


def a1_profile_questions(spark, folder):
    """A question for every field of a session's profile but its key and blank ones."""
    s = table(spark, folder, "sessions").dropDuplicates(["conv_id"])
    profile = F.create_map(F.lit("user_id"), F.col("conv_id"), F.lit("title"), F.col("title"), F.lit("agent"), F.col("agent_name"))
    each = s.select("conv_id", F.explode(profile).alias("field", "value")).where("field not in ('user_id', 'status') and trim(coalesce(value, '')) <> ''")
    return each.select("conv_id", F.concat(F.lit("What is the user's "), "field", F.lit("?")).alias("question"), F.col("value").alias("answer"))


def a2_goal_questions(spark, folder):
    """What is known of the thing that a goal recommends, joined by its name without regard to case."""
    s = table(spark, folder, "sessions").dropDuplicates(["conv_id"])
    goals = s.select("conv_id", F.lower(F.trim(F.regexp_extract(F.concat(F.lit("chat --> recommendation("), F.coalesce("title", F.lit("")), F.lit(")")), r"recommendation\((.*?)\)", 1))).alias("name")).where("name <> ''")
    known = s.where("title is not null").select(F.lower(F.trim("title")).alias("name"), F.lit("agent").alias("attribute"), F.col("agent_name").alias("value")).where("value is not null").distinct()
    return goals.join(known, "name").select("conv_id", F.concat(F.lit("What is the "), "attribute", F.lit(" of what was recommended?")).alias("question"), F.col("value").alias("answer"))


def _generated(kind: str):
    def run(spark, folder):
        return D.conversations(spark, 20, kind).select("conv", "turn", "role", "difficulty")

    return run


QUOTA = {"decision": 3, "key_fact": 3, "todo": 3, "insight": 2, "reminder": 1}


def g22_quota_graph(spark, folder):
    """The best linked rows of each type, at most twelve of a conversation."""
    a = artifacts(spark, folder).where(F.col("obj_type").isin(list(QUOTA))).select("conv_id", "id", "obj_type")
    d = a.join(G.degrees(G.edges(artifacts(spark, folder))), ["conv_id", "id"]).select("conv_id", "id", "obj_type", "degree")
    most = F.lit(0)
    for kind, n in QUOTA.items():
        most = F.when(F.col("obj_type") == kind, n).otherwise(most)
    w = Window.partitionBy("conv_id", "obj_type").orderBy(F.desc("degree"), "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("id", "obj_type", "degree", "rank")


def e7_tfidf_vectors(spark, folder):
    rows = facts(spark, folder).where("content is not null").select("fact_id", "content")
    return L.tfidf(rows, "content", 500, 10).select("fact_id", F.size("vec").alias("dims"))


def _draw_sql() -> str:
    return "((conv * 7919 + turn * 104729 + 42 * 1299709 + ((conv * turn) % 97) * 31) % 100)"


def _generated_sql(kind: str) -> str:
    turns, planted, every = D.PLANTED[kind]
    after = planted[-1] + (D.FILLERS if kind == "hard" else 0)
    document = f"WHEN turn % {every} = 0 THEN 'document'" if every else ""
    levels = " ".join(f"WHEN r < {u} THEN '{n}'" for n, u in D.DIFFICULTY)
    return f"WITH t AS (SELECT c.range AS conv, u.range::INT AS turn FROM range(20) c, range(1, {turns + 1}) u), d AS (SELECT *, {_draw_sql()} AS r FROM t), k AS (SELECT *, CASE WHEN turn IN ({', '.join(map(str, planted))}) THEN 'fact' {document} WHEN turn > {after} AND turn <= {after + D.MOST_DISTRACTORS} AND r < 60 THEN 'distractor' ELSE 'filler' END AS role FROM d) SELECT conv, turn, role, CASE WHEN role = 'fact' THEN CASE {levels} END END AS difficulty FROM k"


_SESSIONS = "s AS (SELECT conv_id, any_value(title) AS title, any_value(agent_name) AS agent_name FROM sessions GROUP BY conv_id)"
QUERIES = {f.__name__: f for f in (s8_flattened_sessions, s9_either_format, s10_dataset_round_trip, s13_result_files, s14_saved_model, f24_listed_questions, i1_injection_orders, i3_inject_json, a1_profile_questions, a2_goal_questions, g22_quota_graph, e7_tfidf_vectors)}
QUERIES |= {f"d{k}_{kind}_conversations": _generated(kind) for k, kind in enumerate(D.PLANTED, 1)}
ORACLE = {
    "s8_flattened_sessions": f"WITH {Q.ENTRIES}, b AS (SELECT conv_id || '#' || (turn_id // 20) AS conv_id, (turn_id // 5)::INT AS session, entry_id, user_text, assistant_text FROM ent) SELECT conv_id, session, 'user' AS role, coalesce(user_text, '') AS text, 'D' || entry_id || ':0' AS dia_id, 'day ' || session AS session_datetime FROM b UNION ALL SELECT conv_id, session, 'assistant', coalesce(assistant_text, ''), 'D' || entry_id || ':1', 'day ' || session FROM b",
    "s9_either_format": f"WITH {_SESSIONS} SELECT s.*, form FROM s, (VALUES ('lines'), ('arrays')) f(form)",
    "s10_dataset_round_trip": f"WITH {Q.FACTS}, b AS (SELECT *, conv_id || '#' || (turn_id // 20) AS id FROM fct) SELECT id, (count(*) OVER (PARTITION BY id))::INT AS n_facts, fact_id, turn_id, content, ground_truth, len(distractors) AS n_distractors FROM b",
    "s13_result_files": _SC + " SELECT agent_name, conv_id, '{\"summary\":{\"n\":' || count(*) || ',\"passed\":' || sum(passed::INT) || '},\"results\":[' || string_agg('{\"id\":' || result_id || ',\"passed\":' || passed || '}', ',' ORDER BY result_id) || ']}' AS json FROM s GROUP BY 1, 2",
    "f24_listed_questions": f"WITH {Q.FACTS}, a AS (SELECT fact_id, unnest(distractors) AS item FROM fct WHERE turn_id % 2 = 0), l AS (SELECT fact_id, trim(unnest(regexp_split_to_array(array_to_string(distractors, chr(10)), '\\r?\\n')), ' ') AS item FROM fct WHERE turn_id % 2 = 1) SELECT * FROM a WHERE trim(item, ' ') <> '' UNION ALL SELECT * FROM l WHERE length(item) > 10",
    "i1_injection_orders": _H + " SELECT 'confidence' AS strategy, id, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC NULLS LAST, id) AS rn FROM s UNION ALL SELECT 'recency', id, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC, id) FROM s UNION ALL SELECT 'relevance', id, rank FROM s WHERE rank <= 10",
    "i3_inject_json": _budget("turn_id DESC", 300, False) + " SELECT conv_id, '[' || string_agg('{' || concat_ws(',', '\"type\":' || to_json(obj_type), '\"content\":' || to_json(coalesce(content, '')), '\"quote\":' || to_json(substr(coalesce(quote, ''), 1, 100)), '\"date\":' || to_json(event_time_raw)) || '}', ',' ORDER BY rn) || ']' AS block FROM k GROUP BY 1",
    "a1_profile_questions": f"WITH {_SESSIONS}, p AS (SELECT conv_id, 'title' AS f, title AS v FROM s UNION ALL SELECT conv_id, 'agent', agent_name FROM s) SELECT conv_id, 'What is the user''s ' || f || '?' AS question, v AS answer FROM p WHERE trim(coalesce(v, ''), ' ') <> ''",
    "a2_goal_questions": f"WITH {_SESSIONS}, g AS (SELECT conv_id, lower(trim(regexp_extract('chat --> recommendation(' || coalesce(title, '') || ')', 'recommendation\\((.*?)\\)', 1), ' ')) AS name FROM s), k AS (SELECT DISTINCT lower(trim(title, ' ')) AS name, agent_name AS value FROM s WHERE title IS NOT NULL AND agent_name IS NOT NULL) SELECT conv_id, 'What is the agent of what was recommended?' AS question, value AS answer FROM g JOIN k USING (name) WHERE name <> ''",
    "g22_quota_graph": _EDGES + ", g AS (SELECT conv_id, id, count(*) AS degree FROM (SELECT conv_id, src AS id FROM e UNION ALL SELECT conv_id, dst FROM e) GROUP BY 1, 2), r AS (SELECT art.id, obj_type, degree, row_number() OVER (PARTITION BY art.conv_id, obj_type ORDER BY degree DESC, art.id) AS rank FROM art JOIN g ON g.conv_id = art.conv_id AND g.id = art.id) SELECT * FROM r WHERE rank <= CASE obj_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTA.items()) + " ELSE 0 END",
}
ORACLE |= {f"d{k}_{kind}_conversations": _generated_sql(kind) for k, kind in enumerate(D.PLANTED, 1)}
