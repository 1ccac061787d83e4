"""JSON in and out: artifact rows, the edge map, conversation files; and the cache key of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schema as S

_ROW = "id string, type string, content string, context string, quote string, source string, turn_id int, confidence double, event_time_raw string, references array<string>, leads_to array<string>, caused_by array<string>"


def to_rows(artifacts: DataFrame) -> DataFrame:
    """(conv_id, id, json): each artifact as one JSON object with its serialised names."""
    names = {"obj_type": "type", "src": "source", "references_ids": "references"}
    cols = [F.col(c).alias(names.get(c, c)) for c in ("id", "obj_type", "content", "context", "quote", "src", "turn_id", "confidence", "event_time_raw", "references_ids", "leads_to", "caused_by")]
    return artifacts.select("conv_id", "id", F.to_json(F.struct(*cols)).alias("json"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Artifacts from JSON objects: missing fields get their defaults, unknown ones are ignored, unknown types become key_fact, broken rows drop out."""
    r = rows.select("conv_id", F.from_json("json", _ROW).alias("r")).where("r.id is not null").select("conv_id", "r.*")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("content", "context", "quote", "source")]
    kind = F.when(F.col("type").isin(S.TYPES), F.col("type")).otherwise("key_fact")
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("references", "leads_to", "caused_by")]
    return r.select("conv_id", "id", kind.alias("obj_type"), *text, F.coalesce("turn_id", F.lit(0)).alias("turn_id"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "event_time_raw", *lists)


def save(artifacts: DataFrame, path: str) -> None:
    """One table for all conversations, which replaces what was there. Rows lie in the order of (conv_id, id).

    A conversation's rows stand together, in one file or a few neighbouring ones, so a reader of one conversation skips the rest by
    the files' statistics. The number of files follows the size of the data, not the number of conversations; conv_id is a column,
    since a folder's name would come back as a number or a date where it looks like one, and an empty one as null.
    """
    artifacts.repartitionByRange("conv_id", "id").sortWithinPartitions("conv_id", "id").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_state(artifacts: DataFrame, edges: DataFrame | None, path: str) -> None:
    """Nodes and, if given, edges of all conversations. The turn counter of a conversation is its last turn."""
    save(artifacts, f"{path}/nodes")
    if edges is not None:
        edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as they were saved; a state without edges has none: they are not rebuilt from the nodes' arrays."""
    nodes = load(spark, f"{path}/nodes")
    if has_state(spark, f"{path}/edges"):
        return nodes, spark.read.parquet(f"{path}/edges")
    return nodes, spark.createDataFrame([], "conv_id string, src string, dst string, relation string")


def has_state(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def edge_map(e: DataFrame) -> DataFrame:
    """(conv_id, relation, src, targets): the forward adjacency."""
    return e.groupBy("conv_id", "relation", "src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def edges_of(m: DataFrame) -> DataFrame:
    """Edges from an adjacency; unknown relations are skipped."""
    return m.where(F.col("relation").isin(S.RELATIONS)).select("conv_id", "src", F.explode("targets").alias("dst"), "relation")


def config_key(*settings: Column) -> Column:
    """Eight hex digits that name a configuration."""
    return F.substring(F.md5(F.to_json(F.struct(*settings))), 1, 8)


def conversations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of conversations, or JSON lines."""
    return spark.read.option("multiLine", not lines).json(path)


def export(facts: DataFrame) -> DataFrame:
    """(conv_id, n_facts, json): the facts of a conversation as one JSON list, in turn order."""
    rows = F.array_sort(F.collect_list(F.struct("turn_id", "fact_id", "content", "ground_truth")))
    return facts.groupBy("conv_id").agg(F.count("*").alias("n_facts"), F.to_json(rows).alias("json"))
