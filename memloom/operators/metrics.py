"""Scores of answers against the truth, and their aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from memloom.functions import text as X
from memloom.functions.stemming import stems


def token_f1(answer: Column, truth: Column, stemmed: bool = False) -> dict[str, Column]:
    """Precision, recall, F1: the shared token set over the lengths of the token lists (repeats lower the score); of stems if asked."""
    a, t = X.words(X.normalised(answer)), X.words(X.normalised(truth))
    if stemmed:
        a, t = stems(a), stems(t)
    shared = F.size(F.array_intersect(a, t))
    p = F.when(F.size(a) > 0, shared / F.size(a)).otherwise(0.0)
    r = F.when(F.size(t) > 0, shared / F.size(t)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def contained(answer: Column, truth: Column) -> Column:
    """Whether the normalised answer holds the normalised truth; an empty truth is contained."""
    return F.contains(X.normalised(answer), X.normalised(truth))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords that the lower-cased answer holds; 0 without keywords."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: low.contains(F.lower(k)))) / F.size(keywords)).otherwise(0.0)


def overlap(answer: Column, truth: Column) -> Column:
    """Share of the truth's keywords among the answer's; 0 without any."""
    a, t = X.overlap_keywords(answer), X.overlap_keywords(truth)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.array_contains(a, w))) / F.size(t)).otherwise(0.0)


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best Indel similarity of the shorter text with a window of the longer of the same length."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best, n = 0, len(short)
    if short in long:
        return 100.0
    codes = {c: sum(1 << i for i, x in enumerate(short) if x == c) for c in set(short)}
    for start in range(-n + 1, len(long)):
        row = (1 << n) - 1  # bit-parallel length of the longest common subsequence
        window = long[max(0, start) : start + n]
        for c in window:
            u = row & codes.get(c, 0)
            row = (row + u) | (row - u)
        lcs = n - (row & ((1 << n) - 1)).bit_count()
        best = max(best, 200.0 * lcs / (n + len(window)))
    return best


@F.pandas_udf(DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """partial_ratio of lower-cased, stripped texts; 0 for null."""
    return pd.Series([0.0 if x is None or y is None else round(partial_ratio(x.strip().lower(), y.strip().lower()), 6) for x, y in zip(a, b)])


def rates(rows: DataFrame, passed: str, by: list[str]) -> DataFrame:
    """(by, n, passed, rate)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("passed"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("rate"))


def macro_and_micro(rows: DataFrame, passed: str, category: str) -> DataFrame:
    """(kind, category, rate): the mean of conversation means, and pooled means per category."""
    per = rows.groupBy("conv_id").agg(F.avg(F.col(passed).cast("double")).alias("r"))
    macro = per.agg(F.round(F.avg("r"), 6).alias("rate")).select(F.lit("macro").alias("kind"), F.lit("all").alias("category"), "rate")
    micro = rows.groupBy(category).agg(F.round(F.avg(F.col(passed).cast("double")), 6).alias("rate")).select(F.lit("micro").alias("kind"), F.col(category).alias("category"), "rate")
    return macro.unionByName(micro)


def diagnosis(f1: Column, answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    none = low.contains("no information") | low.contains("not mentioned") | low.contains("i don't know")
    return F.when(F.trim(low) == "", "NO_INFO").when(none, "CLAIMED_NO_INFO").when(f1 > 0.3, "PARTIAL").when(f1 > 0, "LOW").otherwise("TOTAL_MISS")
