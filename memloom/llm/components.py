"""Connected components of a table of links, by alternating large-star and small-star steps.

Both steps hang nodes of a component under smaller ones; they are joins and minima by
node, so a node with many links is one aggregated row, never a collected list. Each round
writes its links as a table, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node under the least of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours under the least of them; links run from the larger to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that a link names; the component is its least node. Runs until a round changes nothing.

    Links to oneself and null ends are none; repeated links and both directions count once;
    without links there are no rows.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    own = edges.select("a", "b")
    return own.unionByName(edges.select(F.col("b").alias("a"), "b")).distinct().withColumnsRenamed({"a": "node", "b": "component"})
