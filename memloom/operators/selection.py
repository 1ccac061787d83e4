"""Budgeted selection and injection: what to keep under a count, and what to show under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as C


def scored(artifacts: DataFrame, source: str = "heuristic") -> DataFrame:
    """Adds omega (importance), rho (retention) and delta = omega * (1 - rho), rounded to nine places; turns are counted per conversation."""
    # an aggregate and a join, not a window: a conversation with a tenth of all rows is not sorted in one task
    totals = artifacts.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn_id").alias("_total"))
    rho = C.retention(F.col("content"), F.col("turn_id"), F.col("_total"))
    omega = C.importance(F.col("obj_type"), F.col("confidence"), source)
    known = artifacts.join(totals, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return known.withColumn("omega", F.round(omega, 9)).withColumn("rho", F.round(F.coalesce(rho, F.lit(0.0)), 9)).withColumn("delta", F.round(F.col("omega") * (1 - F.col("rho")), 9)).drop("_conv", "_total")


def prioritised(s: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` rows of greatest delta per conversation, with their rank."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("delta"), "turn_id", "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (most or 10))


def retention_bound(s: DataFrame, most: int = 10) -> DataFrame:
    """(conv_id, naturally, gained, total): expected facts kept without help, and what the selection adds."""
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("delta"), "turn_id", "id")))
    sums = ranked.groupBy("conv_id").agg(F.sum(F.col("omega") * F.col("rho")).alias("naturally"), F.sum(F.when(F.col("rank") <= most, F.col("delta")).otherwise(0.0)).alias("gained"))
    return sums.select("conv_id", F.round("naturally", 6).alias("naturally"), F.round("gained", 6).alias("gained"), F.round(F.col("naturally") + F.col("gained"), 6).alias("total"))


def chain_selection(s: DataFrame, chains: DataFrame, most: int = 10, bonus: float = 0.2) -> DataFrame:
    """(conv_id, id, how): whole causal chains by gain per row first, single rows after, at most ``most`` rows per conversation.

    ``chains`` is (conv_id, start, node). Greedy packing is sequential, so each conversation's chains go to one
    pandas call; only the ``most`` best single rows and the chains' own rows are sent there.
    """
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("delta"), "turn_id", "id"))
    members = chains.select("conv_id", "start", F.col("node").alias("id")).unionByName(chains.select("conv_id", "start", F.col("start").alias("id"))).distinct()
    of_chain = members.join(s.select("conv_id", "id", "delta"), ["conv_id", "id"]).select("conv_id", "start", "id", "delta")
    single = s.withColumn("r", rank).where(F.col("r") <= most).select("conv_id", F.lit(None).cast("string").alias("start"), "id", "delta")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        conv, taken, how = rows.conv_id.iloc[0], {}, []
        scored_chains = []
        for start, g in rows[rows.start.notna()].groupby("start"):
            gain = round(g.delta.sum() * (1 + bonus * len(g)), 9)
            scored_chains.append((-gain / len(g), start, list(g.sort_values("id").id)))
        for _, _start, ids in sorted(scored_chains):
            if not any(i in taken for i in ids) and len(taken) + len(ids) <= most:
                for i in ids:
                    taken[i] = "chain"
        for r in rows[rows.start.isna()].sort_values(["delta", "id"], ascending=[False, True]).itertuples():
            if len(taken) < most and r.id not in taken:
                taken[r.id] = "single"
        how = list(taken.values())
        return pd.DataFrame({"conv_id": [conv] * len(taken), "id": list(taken), "how": how})

    return of_chain.unionByName(single).groupBy("conv_id").applyInPandas(pack, "conv_id string, id string, how string")


def injection_order(rows: DataFrame, strategy: str) -> DataFrame:
    """Adds ``rn``: by confidence, by recency, or by relevance as the column ``rank`` gives it, within the conversation."""
    keys = {"confidence": [F.desc_nulls_last("confidence")], "recency": [F.desc("turn_id")], "relevance": [F.col("rank")]}[strategy]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*keys, "id")))


def within_budget(rows: DataFrame, budget: int, markdown: bool = False) -> DataFrame:
    """The longest prefix by ``rn`` whose token costs stay within the budget; it ends at the first overflow."""
    quote = F.substring(F.coalesce("quote", F.lit("")), 1, 150) if markdown else F.lit("")
    cost = F.floor(F.length(F.concat(F.coalesce("content", F.lit("")), quote)) / 4) + 10
    header = 20 if markdown else 5
    used = F.sum("cost").over(Window.partitionBy("conv_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cost", cost).withColumn("used", used).where(F.col("used") <= budget - header)


def _line(kind: Column, style: str) -> Column:
    dated = F.when(F.col("event_time_raw").isNotNull(), F.concat(F.lit("**"), "event_time_raw", F.lit("**: "))).otherwise(F.lit(""))
    content = F.coalesce("content", F.lit(""))
    if style == "compact":
        return F.concat(F.lit("["), F.upper(F.substring(kind, 1, 1)), F.lit("] "), dated, content)
    label = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    quote = F.coalesce("quote", F.lit(""))
    shown = F.when(F.length(quote) > 150, F.concat(F.substring(quote, 1, 150), F.lit("..."))).otherwise(quote)
    cited = F.when(quote != "", F.concat(F.lit('\n  > "'), shown, F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit("- **["), label, F.lit("]** "), dated, content, cited)


def rendered(rows: DataFrame, style: str = "compact") -> DataFrame:
    """(conv_id, block): the lines of a conversation in order, as compact text or markdown."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", _line(F.col("obj_type"), style).alias("line")))), lambda x: x["line"])
    head = F.lit("## Relevant Context from This Conversation\n\n") if style == "markdown" else F.lit("")
    return rows.groupBy("conv_id").agg(F.concat(head, F.array_join(lines, "\n")).alias("block"))


def rendered_json(rows: DataFrame) -> DataFrame:
    """(conv_id, block): the rows of a conversation in order as one JSON array; a quote is cut at 100 characters, a date is there only if known."""
    item = F.to_json(F.struct(F.col("obj_type").alias("type"), F.coalesce("content", F.lit("")).alias("content"), F.substring(F.coalesce("quote", F.lit("")), 1, 100).alias("quote"), F.col("event_time_raw").alias("date")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("j")))), lambda x: x["j"])
    return rows.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("block"))


def statistics(artifacts: DataFrame) -> DataFrame:
    """(conv_id, total, turns, avg_confidence, n per type): 0 where nothing is known."""
    from memloom.schema import TYPES

    counts = [F.sum((F.col("obj_type") == t).cast("long")).alias(f"n_{t}") for t in TYPES]
    return artifacts.groupBy("conv_id").agg(F.count("*").alias("total"), F.max("turn_id").alias("turns"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"), *counts)
