"""Typed edges between artifacts of one conversation, and walks over them.

Edges are (conv_id, src, dst, relation). A causal edge is walkable both ways: leads_to
(a, b) and caused_by (b, a) are the same statement. Walks advance all starts at once by
joins, one per hop; where several paths are equally short the one whose ids sort first
is taken, so results do not depend on the order of rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.operators import relating
from memloom.session import materialize


def edges(artifacts: DataFrame) -> DataFrame:
    """The distinct edges in the three id arrays whose both ends exist in the conversation; ids without white space, lower case."""
    columns = {"references": "references_ids", "leads_to": "leads_to", "caused_by": "caused_by"}
    each = F.array(*[F.struct(F.lit(r).alias("relation"), F.col(c).alias("ids")) for r, c in columns.items()])
    raw = artifacts.select("conv_id", F.col("id").alias("src"), F.explode(each).alias("e")).select("conv_id", "src", "e.relation", F.explode("e.ids").alias("raw"))
    named = raw.select("conv_id", "src", F.lower(F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).alias("dst"), "relation").distinct()
    return named.join(artifacts.select("conv_id", F.col("id").alias("dst")), ["conv_id", "dst"], "left_semi").select("conv_id", "src", "dst", "relation")


def mirrored(e: DataFrame) -> DataFrame:
    """With the reverse of every causal edge, each once."""
    swap = F.when(F.col("relation") == "leads_to", "caused_by").otherwise("leads_to")
    back = e.where("relation <> 'references'").select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst"), swap.alias("relation"))
    return e.unionByName(back).distinct()


def neighbours(e: DataFrame) -> DataFrame:
    """(conv_id, id, neighbour, ord): both directions; references before leads_to before caused_by, outgoing first."""
    order = F.array_position(F.array(*[F.lit(r) for r in S.RELATIONS]), F.col("relation")) * 2
    out = e.select("conv_id", F.col("src").alias("id"), F.col("dst").alias("neighbour"), order.alias("ord"))
    incoming = e.select("conv_id", F.col("dst").alias("id"), F.col("src").alias("neighbour"), (order + 1).alias("ord"))
    return out.unionByName(incoming).groupBy("conv_id", "id", "neighbour").agg(F.min("ord").alias("ord"))


def walk(e: DataFrame, starts: DataFrame, hops: int | None, both_ways: bool = False) -> DataFrame:
    """(conv_id, start, node, hops, path): nodes within ``hops`` of each start (conv_id, start), without the start; one shortest path each.

    Without ``hops`` it goes on until no new node is found. Each hop is then written to the
    shared folder, and all hops so far once more every 16, so the plan does not grow with the depth.
    """
    steps = e.select("conv_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    if both_ways:
        steps = steps.unionByName(e.select("conv_id", F.col("dst").alias("a"), F.col("src").alias("b")))
    steps = steps.distinct()
    seen = starts.select("conv_id", "start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.col("start").alias("path")).distinct()
    if hops is None:
        steps, seen = materialize(steps, "steps"), materialize(seen, "seen")
    frontier = seen
    for hop in count(1) if hops is None else range(1, hops + 1):
        reached = frontier.join(steps.withColumnRenamed("a", "node"), ["conv_id", "node"]).groupBy("conv_id", "start", F.col("b").alias("node")).agg(F.min(F.concat_ws(">", "path", "b")).alias("path"))
        frontier = reached.join(seen.select("conv_id", "start", "node"), ["conv_id", "start", "node"], "left_anti").select("conv_id", "start", "node", F.lit(hop).alias("hops"), "path")
        if hops is None:
            frontier = materialize(frontier, f"hop{hop}")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
        if hops is None and hop % 16 == 0:
            seen = materialize(seen, "seen")
    return seen.where("hops > 0")


def without_incoming(nodes: DataFrame, e: DataFrame) -> DataFrame:
    return nodes.join(e.select("conv_id", F.col("dst").alias("id")), ["conv_id", "id"], "left_anti")


def without_outgoing(nodes: DataFrame, e: DataFrame) -> DataFrame:
    return nodes.join(e.select("conv_id", F.col("src").alias("id")), ["conv_id", "id"], "left_anti")


def levels(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(conv_id, id, level) by peeling nodes without open predecessors; nodes on or behind a cycle get null.

    Each round is written to the shared folder, and all levels so far once more every 16, so the plan does not grow with the depth.
    """
    left = nodes.select("conv_id", "id").distinct()
    steps = e.select("conv_id", "src", "dst").distinct()
    done = None
    for level in count():
        free = materialize(without_incoming(left, steps).withColumn("level", F.lit(level)), f"level{level}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        if level % 16 == 15:
            done = materialize(done, "done")
        left = left.join(free, ["conv_id", "id"], "left_anti")
        steps = steps.join(free.select("conv_id", F.col("id").alias("src")), ["conv_id", "src"], "left_anti")
        left, steps = materialize(left, "left"), materialize(steps, "steps")
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)


def topological_order(nodes: DataFrame, e: DataFrame, relation: str = "leads_to") -> DataFrame:
    """(conv_id, id, level): an order of each conversation's nodes by level, then id, in which every edge of the relation leads on.

    A conversation with a cycle has no order, and an unknown relation gives none at all.
    """
    if relation not in S.RELATIONS:
        return nodes.select("conv_id", "id", F.lit(0).alias("level")).where("false")
    found = materialize(levels(nodes, e.where(F.col("relation") == relation)), "levels")
    return found.join(found.where("level is null").select("conv_id").distinct(), "conv_id", "left_anti")


def expansion(hits: DataFrame, e: DataFrame, hops: int = 3, decay: float = 0.8) -> DataFrame:
    """Graph neighbours of ranked results (conv_id, q_id, doc_id, rank, score) in the order of a breadth-first visit from the best result on.

    A node is scored by the first node that reaches it, parents in the order in which they were reached, their neighbours in the
    order of ``neighbours``, then by id: the parent's score times decay^hop, so h hops multiply by decay^(h(h+1)/2). Seeds stay out.
    """
    near = materialize(neighbours(e).select("conv_id", "id", "neighbour", "ord"), "neighbours")
    hits = materialize(hits.select("conv_id", "q_id", "doc_id", "rank", "score"), "hits")  # every hop reads both
    seen = hits.select("conv_id", "q_id", "doc_id", F.lit(0).alias("hops"), F.col("score").cast("double").alias("score"), F.col("rank").alias("pos"))
    layer = seen
    by_visit = Window.partitionBy("conv_id", "q_id").orderBy("first")
    for hop in range(1, hops + 1):
        reached = layer.withColumnRenamed("doc_id", "id").join(near, ["conv_id", "id"]).groupBy("conv_id", "q_id", F.col("neighbour").alias("doc_id")).agg(F.min(F.struct("pos", "ord", "neighbour")).alias("first"), F.min_by("score", F.struct("pos", "ord")).alias("parent"))
        new = reached.join(seen.select("conv_id", "q_id", "doc_id"), ["conv_id", "q_id", "doc_id"], "left_anti")
        layer = new.select("conv_id", "q_id", "doc_id", F.lit(hop).alias("hops"), (F.col("parent") * decay**hop).alias("score"), F.row_number().over(by_visit).alias("pos"))
        seen = seen.unionByName(layer)
    return seen.where("hops > 0").select("conv_id", "q_id", "doc_id", "hops", F.round("score", 6).alias("score"))


def seed_expansion(hits: DataFrame, e: DataFrame, hops: int = 2, decay: float = 0.8) -> DataFrame:
    """Graph neighbours of ranked results by true distance: decay^hops of the first seed, by rank, that reaches them. Seeds stay out."""
    hits = materialize(hits.select("conv_id", "q_id", "doc_id", "rank", "score"), "hits")
    near = walk(e, hits.select("conv_id", F.col("doc_id").alias("start")), hops, both_ways=True)
    found = hits.select("conv_id", "q_id", F.col("doc_id").alias("start"), "rank", "score").join(near, ["conv_id", "start"])
    first = found.groupBy("conv_id", "q_id", F.col("node").alias("doc_id")).agg(F.min_by(F.struct("score", "hops"), "rank").alias("s"))
    new = first.join(hits.select("conv_id", "q_id", "doc_id"), ["conv_id", "q_id", "doc_id"], "left_anti")
    return new.select("conv_id", "q_id", "doc_id", F.col("s.hops").alias("hops"), F.round(F.col("s.score") * F.pow(F.lit(decay), F.col("s.hops")), 6).alias("score"))


def degrees(e: DataFrame) -> DataFrame:
    ends = e.select("conv_id", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("conv_id", "id").agg(F.count("*").alias("degree"))


def cooccurrence(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(a, b, n), a < b: how many rows name both items."""
    named = rows.select("conv_id", key, F.explode(F.array_distinct(F.transform(items, X.entity_name))).alias("item")).where("item is not null and item <> ''")
    other = named.withColumnRenamed("item", "b")
    return named.withColumnRenamed("item", "a").join(other, ["conv_id", key]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def featured(artifacts: DataFrame) -> DataFrame:
    """What the relation rules compare: a unit vector, the keywords of content and quote, those of the content."""
    whole = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("quote", F.lit("")))
    return artifacts.select("conv_id", "id", "turn_id", "obj_type", V.unit(V.hash_vector(whole)).alias("vec"), X.keyword_set(whole).alias("kw_all"), X.keyword_set(F.col("content")).alias("kw_content"))


def earlier_pairs(f: DataFrame, back: int | None = None) -> DataFrame:
    """New rows with the rows of earlier turns, at most ``back`` turns before: by an equal join on turn buckets, not by a range scan."""
    new = f.select(*[F.col(c).alias(f"n_{c}") if c != "conv_id" else F.col(c) for c in f.columns])
    old = f.select(*[F.col(c).alias(f"o_{c}") if c != "conv_id" else F.col(c) for c in f.columns])
    if back is None:
        pairs = new.join(old, "conv_id").where("o_turn_id < n_turn_id")
    else:
        bucket = F.floor(F.col("n_turn_id") / back)
        new = new.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
        old = old.withColumn("bucket", F.floor(F.col("o_turn_id") / back))
        pairs = new.join(old, ["conv_id", "bucket"]).where(f"o_turn_id < n_turn_id and o_turn_id >= n_turn_id - {back}")
    return pairs.withColumn("overlap", F.arrays_overlap("n_kw_all", "o_kw_content")).withColumn("sim", F.round(V.dot(F.col("n_vec"), F.col("o_vec")), 6))


def relation_rule(f: DataFrame, rule: int, reference: float = 0.5, causal: float = 0.45, floor: float = 0.3) -> DataFrame:
    """(conv_id, src, dst, relation) of one of the seven inference rules over rows of earlier turns."""

    def of(new: list[str], old: list[str], back: int | None) -> DataFrame:
        p = earlier_pairs(f.where(F.col("obj_type").isin(*new, *old)), back)
        return p.where(F.col("n_obj_type").isin(new) & F.col("o_obj_type").isin(old))

    if rule == 1:
        return relating.references(f, reference, floor).withColumn("relation", F.lit("references"))
    strong = F.when(F.col("overlap"), F.col("sim") >= floor)
    best = Window.partitionBy("conv_id", "n_id")
    if rule == 2:
        fit = of(["todo"], ["decision"], 5).where(strong.otherwise(F.col("sim") >= causal))
        got, relation = fit.withColumn("r", F.row_number().over(best.orderBy(F.desc("sim"), "o_turn_id", "o_id"))).where("r = 1"), "caused_by"
    elif rule == 3:
        got, relation = of(["insight"], ["key_fact", "decision"], 3).where(strong.otherwise(F.col("sim") >= causal)), "caused_by"
    elif rule == 4:
        fit = of(["decision"], ["key_fact", "reminder"], 2).where("overlap")
        got, relation = fit.withColumn("r", F.row_number().over(best.orderBy(F.desc("o_turn_id"), "o_id"))).where("r <= 2"), "caused_by"
    elif rule in (5, 6):
        new = "event" if rule == 5 else "relationship"
        got, relation = of([new], ["person_attribute"], None).where((F.col("sim") >= reference) | F.col("overlap")), "references"
    elif rule == 7:
        got, relation = of(["decision"], ["event"], 10).where("overlap"), "caused_by"
    else:
        raise ValueError(f"no rule {rule}")
    return got.select("conv_id", F.col("n_id").alias("src"), F.col("o_id").alias("dst"), F.lit(relation).alias("relation"))
