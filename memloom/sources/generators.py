"""Seeded conversations with planted facts: every choice is arithmetic on the conversation, the turn and the seed, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: turns of planted facts by kind of dataset, and how difficulties are mixed (in hundredths, added up)
PLANTED = {"standard": (50, [3, 5, 7, 9], 0), "hard": (50, [3], 0), "long": (200, [10, 50, 100, 150], 20)}
DIFFICULTY = [("easy", 25), ("medium", 60), ("hard", 85), ("adversarial", 100)]
FILLERS, MOST_DISTRACTORS = 20, 3


def drawn(conv: Column, turn: Column, seed: int) -> Column:
    """A number from 0 to 99."""
    return F.pmod(conv * 7919 + turn * 104729 + F.lit(seed) * 1299709 + F.pmod(conv * turn, F.lit(97)) * 31, F.lit(100))


def conversations(spark: SparkSession, n: int, kind: str = "standard", seed: int = 42) -> DataFrame:
    """(conv, turn, role, difficulty) of ``n`` conversations: turns that plant a fact, distract from the last one, bring a document, or fill.

    A hard conversation follows its fact by FILLERS fillers and then distracts; the others distract at most MOST_DISTRACTORS turns after
    their last fact. Another kind is an error.
    """
    if kind not in PLANTED:
        raise ValueError(f"unknown kind {kind!r}")
    turns, planted, every = PLANTED[kind]
    rows = spark.range(n).select(F.col("id").alias("conv"), F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    r = drawn(F.col("conv"), F.col("turn"), seed)
    after = planted[-1] + (FILLERS if kind == "hard" else 0)
    distracts = (F.col("turn") > after) & (F.col("turn") <= after + MOST_DISTRACTORS) & (r < 60)
    role = F.when(F.col("turn").isin(planted), "fact").when(F.lit(every > 0) & (F.col("turn") % max(every, 1) == 0), "document").when(distracts, "distractor").otherwise("filler")
    level = F.lit(None).cast("string")
    for name, upto in reversed(DIFFICULTY):
        level = F.when(r < upto, name).otherwise(level)
    return rows.select("conv", "turn", role.alias("role"), F.when(role == "fact", level).alias("difficulty"))
