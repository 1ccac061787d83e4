"""Conversation files: sessions under numbered names, JSON arrays or lines, nested datasets and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = r"^session_(\d+)$"
_LINES = "array<struct<speaker:string,text:string,dia_id:string>>"


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, fields): conversations whose sessions stand under names of their own, each field as its JSON text."""
    return spark.read.schema("id string, conversation map<string,string>").json(path).select(F.col("id").alias("conv_id"), F.col("conversation").alias("fields"))


def flattened(raw: DataFrame) -> DataFrame:
    """(conv_id, session, pos, role, text, dia_id, session_datetime): the lines of all sessions; the first speaker is the user, every other the assistant."""
    each = raw.select("conv_id", "fields", F.explode("fields").alias("name", "body")).where(F.col("name").rlike(SESSION))
    number = F.regexp_extract("name", SESSION, 1).cast("int")
    lines = each.select("conv_id", F.col("fields")["speaker_a"].alias("first"), number.alias("session"), F.element_at("fields", F.concat("name", F.lit("_date_time"))).alias("session_datetime"), F.posexplode(F.from_json("body", _LINES)).alias("pos", "l"))
    role = F.when(F.col("l.speaker") == F.col("first"), "user").otherwise("assistant")
    return lines.select("conv_id", "session", "pos", role.alias("role"), "l.text", "l.dia_id", "session_datetime")


def as_sessions(lines: DataFrame) -> DataFrame:
    """(json): one object per conversation of (conv_id, session, pos, speaker, text, dia_id, session_datetime), as ``load_sessions`` reads it."""
    line = F.struct("pos", "speaker", "text", "dia_id")
    said = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), x["dia_id"].alias("dia_id")))
    sessions = lines.groupBy("conv_id", "session").agg(F.to_json(said).alias("body"), F.max("session_datetime").alias("at"))
    name = F.concat(F.lit("session_"), F.col("session"))
    fields = sessions.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", _field(name, F.col("body")), _field(F.concat(name, F.lit("_date_time")), _text(F.col("at")))))), ",").alias("f"))
    head = F.concat(F.lit('{"id":'), _text(F.col("conv_id")), F.lit(',"conversation":{"speaker_a":"user","speaker_b":"assistant",'), "f", F.lit("}}"))
    return fields.select(head.alias("json"))


def _text(c: Column) -> Column:
    """A JSON text, null for null."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) if c is not None else c


def _field(name: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit('"'), name, F.lit('":'), body))


def load_either(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects from a file of lines, or from arrays that stand on one line each or over several."""
    head = spark.read.text(path).where("trim(value) <> ''").first()
    spread = head is not None and head.value.strip() in ("[", "{")
    return spark.read.schema(schema).option("multiLine", spread).json(path)


def nested(facts: DataFrame, key: Column) -> DataFrame:
    """(json): conversations with their facts inside, as a dataset file keeps them."""
    item = F.struct("fact_id", "turn_id", "fact_type", "content", "ground_truth", "distractors")
    return facts.groupBy(key.alias("id")).agg(F.array_sort(F.collect_list(item)).alias("planted_facts")).select(F.to_json(F.struct("id", "planted_facts", F.struct(F.size("planted_facts").alias("n_facts")).alias("metadata"))).alias("json"))


def load_nested(spark: SparkSession, path: str) -> DataFrame:
    """(id, n_facts, fact_id, turn_id, fact_type, content, ground_truth, distractors): the facts of a dataset file."""
    inner = "array<struct<fact_id:string,turn_id:int,fact_type:string,content:string,ground_truth:string,distractors:array<string>>>"
    raw = spark.read.schema(f"id string, planted_facts {inner}, metadata struct<n_facts:int>").json(path)
    return raw.select("id", "metadata.n_facts", F.explode("planted_facts").alias("f")).select("id", "n_facts", "f.*")


def results_json(scored: DataFrame) -> DataFrame:
    """(agent_name, conv_id, json): the results of an agent on a conversation with their summary, as a result file keeps them."""
    items = F.array_sort(F.collect_list(F.struct(F.col("result_id").alias("id"), "passed")))
    g = scored.groupBy("agent_name", "conv_id").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed"), items.alias("results"))
    return g.select("agent_name", "conv_id", F.to_json(F.struct(F.struct("n", F.col("n_passed").alias("passed")).alias("summary"), "results")).alias("json"))
