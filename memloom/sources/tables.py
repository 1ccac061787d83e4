"""Parquet tables by name, and the first-delivery rule they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``: one parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Each key once: the row that sorts first by ``order`` (nulls last).

    Without ``order`` any one of the deliveries is kept; deliveries of one key are
    equal in every column that the callers read. Rows whose key is null stay one
    per null key, as in a GROUP BY.
    """
    if not order:
        return df.dropDuplicates(list(key))
    w = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_once", F.row_number().over(w)).where("_once = 1").drop("_once")
