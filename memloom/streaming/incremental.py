"""Conversations as streams: the same operators fed by files that arrive.

State is keyed by conversation and kept by Structured Streaming; ``availableNow`` reads
what is there and ends, so a stream can be compared with its batch result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import extraction as E
from memloom.session import shared_dir


def source(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A parquet table as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    parent, leaf = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", leaf if not _is_folder(spark, path) else "*.parquet").parquet(parent if not _is_folder(spark, path) else path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isDirectory()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): event-time windows; rows later than ``late`` behind the newest are dropped by the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def conversation_state(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, last_turn): the running registry of sessions."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn_id").alias("last_turn"))


def run_to_table(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what is available into a table in the shared folder and reads it.

    'complete' keeps the last state, 'append' all rows. Each micro-batch is written under its
    own number and overwrites itself if it is repeated, so a restart does not double rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/memloom/stream-{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        target = f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows") if mode == "complete" else spark.read.parquet(f"{base}/rows").drop("batch")


def extracted_stream(turns: DataFrame) -> DataFrame:
    """Rule extraction of arriving turns; stateless, so append mode."""
    return E.rule_artifacts(turns)


def upsert(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key in one folder per batch number."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """What ``upsert`` has kept: over all batches the latest row per key."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
