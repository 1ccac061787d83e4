"""Rule scores of artifacts: confidence, retention, importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import text as X


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def trigger_part(kind: Column, content: Column) -> Column:
    """Weight by trigger words of the type: none -0.2, one half the weight, two or more all; 0 for types without triggers."""
    out = F.lit(0.0)
    for name, (weight, phrases) in S.SCORE_TRIGGERS.items():
        n = X.count_phrases(content, phrases)
        out = F.when(kind == name, F.when(n == 0, F.lit(-0.2)).otherwise(F.least(F.lit(weight), F.lit(weight) * n / 2))).otherwise(out)
    return out


def length_part(content: Column) -> Column:
    n = F.coalesce(F.length(content), F.lit(0))
    return F.when(n < 10, F.lit(-0.3)).when(n <= 500, F.lit(0.1)).otherwise(-F.least(F.lit(0.3), (n - 500) / 1000))


def type_part(kind: Column, content: Column) -> Column:
    fact = X.has_digits(content) | F.coalesce(content.rlike(r"[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(False))
    return (
        F.when(kind == "key_fact", F.when(fact, F.lit(0.1)).otherwise(F.lit(-0.1)))
        .when((kind == "todo") & X.contains_any(content, S.TODO_VERBS), F.lit(0.1))
        .when((kind == "decision") & X.contains_any(content, ["will", "going to", "decided"]), F.lit(0.1))
        .otherwise(F.lit(0.0))
    )


def rule_score(kind: Column, content: Column, context: Column) -> Column:
    """0.5 plus the trigger, length, context and type parts, between 0 and 1."""
    context_part = F.when(F.coalesce(F.trim(context), F.lit("")) != "", F.lit(0.1)).otherwise(F.lit(0.0))
    return _clamp(F.lit(0.5) + trigger_part(kind, content) + length_part(content) + context_part + type_part(kind, content))


def blended(rule: Column, judged: Column) -> Column:
    """0.3 of the rule score and 0.7 of a model's, the rule score alone where there is none."""
    return F.coalesce(0.3 * rule + 0.7 * judged, rule)


def retention(content: Column, turn: Column, total: Column, alpha: float = 0.1, beta: float = 0.8) -> Column:
    """How likely a fact survives compression: later, with digits or names, and short."""
    recency = F.when(total <= 0, F.lit(1.0)).otherwise(turn / total)
    return _clamp(
        F.lit(alpha) + F.lit(beta) * recency + F.when(X.has_digits(content), 0.1).otherwise(0.0) + F.when(X.has_names(content), 0.1).otherwise(0.0) - F.when(F.length(content) > 200, 0.05).otherwise(0.0)
    )


def type_weight(kind: Column) -> Column:
    return reduce(lambda c, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(c), S.IMPORTANCE.items(), F.lit(0.5))


def importance(kind: Column, confidence: Column, source: str = "heuristic") -> Column:
    """By confidence alone, or by type weight and confidence."""
    sure = F.coalesce(confidence, F.lit(0.0))
    return sure if source == "confidence" else type_weight(kind) * sure


def inferred_type(reference: Column) -> Column:
    """The first type one of whose hints the text holds; null if none."""
    out = F.lit(None).cast("string")
    for name, hints in reversed(list(S.TYPE_HINTS.items())):
        out = F.when(X.contains_any(reference, hints), F.lit(name)).otherwise(out)
    return out
