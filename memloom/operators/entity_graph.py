"""A light entity graph: entities of turns, merged by name, joined where a turn names both; matched, expanded and shown for questions.

Nodes are (conv_id, name, type, turns), links (conv_id, a, b, n) with a < b.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import entities as N
from memloom.functions import vectors as V
from memloom.operators import blocks
from memloom.operators import graph as G
from memloom.session import materialize


def mentions(entries: DataFrame) -> DataFrame:
    """(conv_id, entry_id, turn_id, name, type): the entities of each turn, both sides together."""
    text = F.concat_ws(" ", "user_text", "assistant_text")
    return entries.select("conv_id", "entry_id", "turn_id", F.explode(N.typed(text)).alias("e")).select("conv_id", "entry_id", "turn_id", "e.name", "e.type").where("name <> ''")


def nodes(m: DataFrame) -> DataFrame:
    """One node per name of a conversation: the type of its first mention, and all its turns."""
    first = F.min(F.struct("turn_id", "entry_id", "type"))
    return m.groupBy("conv_id", "name").agg(first.alias("f"), F.array_sort(F.collect_set("turn_id")).alias("turns")).select("conv_id", "name", F.col("f.type").alias("type"), "turns")


def links(m: DataFrame) -> DataFrame:
    """How many turns name both ends."""
    a = m.select("conv_id", "entry_id", F.col("name").alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), ["conv_id", "entry_id"]).where("a < b").groupBy("conv_id", "a", "b").agg(F.count("*").alias("n"))


def match(n: DataFrame, questions: DataFrame, most: int = 5, least: float = 0.3) -> DataFrame:
    """(conv_id, q_id, name): nodes that a question (conv_id, q_id, question) names.

    A question's entity means the node of its name, else every node whose name holds it or lies in it; a question without
    any takes the ``most`` nodes whose names are nearest by cosine, above ``least``.
    """
    asked = questions.select("conv_id", "q_id", F.explode(N.typed(F.col("question"))).alias("e")).select("conv_id", "q_id", F.col("e.name").alias("asked")).where("asked <> ''").distinct()
    names = n.select("conv_id", "name")
    exact = asked.join(names.withColumn("asked", F.col("name")), ["conv_id", "asked"])
    inexact = asked.join(exact, ["conv_id", "q_id", "asked"], "left_anti").join(names, "conv_id").where(F.col("name").contains(F.col("asked")) | F.col("asked").contains(F.col("name")))
    named = exact.select("conv_id", "q_id", "name").unionByName(inexact.select("conv_id", "q_id", "name")).distinct()
    none = F.array().cast("array<string>")
    left = questions.join(named, ["conv_id", "q_id"], "left_anti").select("conv_id", "q_id", V.unit(V.hash_vector(F.col("question"))).alias("vec"), none.alias("tokens"))
    docs = names.select("conv_id", F.col("name").alias("doc_id"), V.unit(V.hash_vector(F.col("name"))).alias("vec"), none.alias("tokens"))
    w = Window.partitionBy("conv_id", "q_id").orderBy(F.desc("score"), "doc_id")
    near = blocks.scored(docs, left, most, "semantic").withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) & (F.col("score") > least))
    return named.unionByName(near.select("conv_id", "q_id", F.col("doc_id").alias("name")))


def expand(seeds: DataFrame, l: DataFrame, hops: int = 2, most: int = 5, few: int = 3) -> DataFrame:
    """(conv_id, q_id, name): seeds and what lies within ``hops`` links; if that is more than 3 * ``most``, the seeds and each one's first ``few`` neighbours by name."""
    e = l.select("conv_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    near = G.walk(e, seeds.select("conv_id", F.col("name").alias("start")).distinct(), hops, both_ways=True).select("conv_id", F.col("start").alias("name"), "node", "hops")
    reached = materialize(seeds.join(near, ["conv_id", "name"]).select("conv_id", "q_id", "name", "node", "hops"), "reached")
    every = seeds.unionByName(reached.select("conv_id", "q_id", F.col("node").alias("name"))).distinct()
    wide = every.groupBy("conv_id", "q_id").count().where(F.col("count") > 3 * most).select("conv_id", "q_id")
    w = Window.partitionBy("conv_id", "q_id", "name").orderBy("node")
    first = reached.where("hops = 1").withColumn("r", F.row_number().over(w)).where(F.col("r") <= few).select("conv_id", "q_id", F.col("node").alias("name"))
    short = seeds.unionByName(first).distinct().join(wide, ["conv_id", "q_id"], "left_semi")
    return every.join(wide, ["conv_id", "q_id"], "left_anti").unionByName(short)


def context(picked: DataFrame, n: DataFrame, l: DataFrame) -> DataFrame:
    """(conv_id, q_id, block): the picked nodes by type with their turns, and the links among them."""
    shown = picked.join(n, ["conv_id", "name"])
    line = F.concat(F.lit("- **"), "name", F.lit("** (from turns: "), F.array_join(F.col("turns").cast("array<string>"), ", "), F.lit(")"))
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    by_type = shown.groupBy("conv_id", "q_id", "type").agg(F.concat(F.lit("### "), "type", F.lit("\n"), lines(line)).alias("part"))
    parts = by_type.groupBy("conv_id", "q_id").agg(F.array_join(F.array_sort(F.collect_list("part")), "\n\n").alias("nodes"))
    ends = picked.select("conv_id", "q_id", F.col("name").alias("a")).join(l, ["conv_id", "a"]).join(picked.select("conv_id", "q_id", F.col("name").alias("b")), ["conv_id", "q_id", "b"])
    tied = ends.groupBy("conv_id", "q_id").agg(lines(F.concat(F.lit("- "), "a", F.lit(" --[related_to]--> "), "b")).alias("links"))
    both = parts.join(tied, ["conv_id", "q_id"], "left")
    return both.select("conv_id", "q_id", F.concat("nodes", F.coalesce(F.concat(F.lit("\n\n### Relationships\n"), "links"), F.lit(""))).alias("block"))
