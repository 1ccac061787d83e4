"""Session helpers: local sessions for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "memloom", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where it is unset and the session is local, as in tests, a temporary one.

    On a cluster a folder of one machine would hold a part of each table on every executor, so there an unset name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="memloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def drop_tables(spark: SparkSession) -> int:
    """Removes the tables that ``materialize`` has written in this process, and says how many. Call it once results that read them are stored."""
    n = len(_written)
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def keep(df: DataFrame) -> DataFrame:
    """Persist with spill to disk; a lost block is recomputed from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Where a public vocabulary file lies: ``memloom.tokenizers.dir`` of the session,
    else the environment's MEMLOOM_TOKENIZERS, else /opt/tokenizers."""
    base = spark.conf.get("memloom.tokenizers.dir", None) or os.environ.get("MEMLOOM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(base, name)
