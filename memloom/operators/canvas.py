"""Changing a canvas: adding, linking, removing and clearing, each as a set operation on all conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.operators import graph as G

ARRAYS = {"references": "references_ids", "leads_to": "leads_to", "caused_by": "caused_by"}


def add(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with those of ``more`` whose (conv_id, id) is new; adding a node again changes nothing. Columns are those of ``nodes``."""
    new = more.dropDuplicates(["conv_id", "id"]).join(nodes.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    return nodes.unionByName(new, allowMissingColumns=True).select(nodes.columns)


def link(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``linked`` to requests (conv_id, src, dst, relation): whether both ends are nodes of the conversation and the relation is known.

    A link that is there already counts as made. Null ends and relations give false.
    """
    ends = nodes.select("conv_id", "id").distinct()
    from_there = ends.select("conv_id", F.col("id").alias("src"), F.lit(True).alias("_from"))
    to_there = ends.select("conv_id", F.col("id").alias("dst"), F.lit(True).alias("_to"))
    both = requests.join(from_there, ["conv_id", "src"], "left").join(to_there, ["conv_id", "dst"], "left")
    known = F.coalesce(F.col("relation").isin(S.RELATIONS), F.lit(False))
    return both.withColumn("linked", F.col("_from").isNotNull() & F.col("_to").isNotNull() & known).drop("_from", "_to")


def linked_edges(requests: DataFrame) -> DataFrame:
    """The edges that successful requests make, with the mirror of causal ones."""
    return G.mirrored(requests.where("linked").select("conv_id", "src", "dst", "relation").distinct())


def with_arrays(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, references_ids, leads_to, caused_by): the id arrays of each node as its edges say, sorted; [] without any."""
    per = edges.groupBy("conv_id", F.col("src").alias("id")).agg(*[F.array_sort(F.collect_set(F.when(F.col("relation") == r, F.col("dst")))).alias(c) for r, c in ARRAYS.items()])
    none = F.array().cast("array<string>")
    return nodes.select("conv_id", "id").join(per, ["conv_id", "id"], "left").select("conv_id", "id", *[F.coalesce(c, none).alias(c) for c in ARRAYS.values()])


def standing(removals: DataFrame, tab: str) -> DataFrame:
    """(id): objects of a table that are off the canvas: removed and not restored."""
    return removals.where((F.col("tab") == tab) & F.col("restored_at").isNull() & F.col("object_id").isNotNull()).select(F.col("object_id").alias("id")).distinct()


def remove(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids, "id", "left_anti")


def remove_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges neither of whose ends is removed; the id arrays of the neighbours keep the dead id."""
    gone = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    return gone.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns)


def clear(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nothing is left of the given conversations (conv_id)."""
    return nodes.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def sizes(nodes: DataFrame) -> DataFrame:
    """(conv_id, size, turn_count): number of nodes and last turn."""
    return nodes.groupBy("conv_id").agg(F.count("*").alias("size"), F.max("turn_id").alias("turn_count"))
