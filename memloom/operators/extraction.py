"""From turns to artifacts: trigger rules, model output, time expressions, deduplication, reference resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom import schema as S
from memloom.functions import temporal as T
from memloom.functions import text as X
from memloom.operators import resolving
from memloom.session import materialize


def rule_artifacts(turns: DataFrame, triggers: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """(conv_id, turn_id, entry_id, obj_type, content, quote, src): one row per type whose trigger words the turn holds."""
    user, said = F.coalesce("user_text", F.lit("")), F.coalesce("assistant_text", F.lit(""))
    spoken = F.when(user != "", user).otherwise(said)
    rows = []
    for kind, (side, phrases) in (triggers or S.EXTRACT_TRIGGERS).items():
        text = said if side == "assistant" else F.concat(user, F.lit(" "), said)
        quote = said if side == "assistant" else spoken
        source = "assistant" if side == "assistant" else "user"
        rows.append(F.when(X.contains_any(text, phrases), F.struct(F.lit(kind).alias("obj_type"), F.substring(quote, 1, 200).alias("content"), quote.alias("quote"), F.lit(source).alias("src"))))
    return turns.select("conv_id", "turn_id", "entry_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("a")).select("conv_id", "turn_id", "entry_id", "a.*")


def without_repeats(second: DataFrame, first: DataFrame, share: float = 0.8) -> DataFrame:
    """Rows of a second pass that a first pass of the same (conv_id, turn_id) has neither word for word nor in more than ``share`` of the smaller word set."""
    words = lambda c: F.array_distinct(X.words(F.lower(F.col(c))))
    a = second.withColumn("wa", words("content"))
    b = first.select("conv_id", "turn_id", F.lower("content").alias("lb"), words("content").alias("wb"))
    small = F.least(F.size("wa"), F.size("wb"))
    same = (F.lower("content") == F.col("lb")) | ((small > 0) & (F.size(F.array_intersect("wa", "wb")) / F.greatest(small, F.lit(1)) > share))
    return a.alias("a").join(b.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn_id") == F.col("b.turn_id")) & same, "left_anti").drop("wa")


def time_artifacts(rows: DataFrame, text: str, session: str) -> DataFrame:
    """Adds one row per time expression of ``text``: expression, start, is_absolute, event_time (as written, or resolved from the session), confidence."""
    each = rows.withColumn("x", F.explode(T.spans(F.col(text)))).select("*", "x.expression", "x.start", "x.is_absolute").drop("x")
    when = F.when(F.col("is_absolute"), F.col("expression")).otherwise(T.resolved(F.col("expression"), T.session_time(F.col(session))))
    sure = F.when(F.col("is_absolute"), 0.95).when(when.isNotNull(), 0.9).otherwise(0.85)
    return each.withColumn("event_time", when).withColumn("sure", sure)


def with_sessions(artifacts: DataFrame) -> DataFrame:
    """Adds the session stamp of the own turn, else of the closest earlier one: an as-of join as a running last value."""
    own = F.max("session_datetime").over(Window.partitionBy("conv_id", "turn_id"))
    last = F.last("session_datetime", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn_id", "id").rowsBetween(Window.unboundedPreceding, 0))
    return artifacts.withColumn("session", F.coalesce(own, last))


def resolved_times(artifacts: DataFrame) -> DataFrame:
    """(id, event_time_raw, session, event_time) for rows with a relative expression."""
    rows = with_sessions(artifacts).where(X.contains_any(F.col("event_time_raw"), S.RELATIVE_WORDS))
    return rows.select("id", "event_time_raw", "session", T.resolved(F.col("event_time_raw"), T.session_time(F.col("session"))).alias("event_time"))


def resolve_by_keywords(references: DataFrame, candidates: DataFrame, floor: float = 0.3) -> DataFrame:
    """(ref_id, resolved_id, confidence): the best candidate of the conversation by shared words, type and turn; null below ``floor``."""
    return _by_keywords(resolving.best(references, candidates, True, False, floor))


def _by_keywords(best: DataFrame) -> DataFrame:
    return best.select("ref_id", F.col("k.id").alias("resolved_id"), F.col("k.confidence").alias("confidence"))


def parsed(rows: DataFrame, text: str, extra: list[str]) -> DataFrame:
    """Artifacts that a model wrote as JSON: an object or an array of them, with or without a code fence.

    Columns ``extra`` and (obj_type, content, quote, context, confidence, event_time_raw). An unknown type drops the
    artifact, a missing one is key_fact; a missing confidence is 0.8; what is no JSON gives no rows.
    """
    body = X.fenced_json(F.col(text))
    listed = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    item = "array<struct<type:string,content:string,citation:string,context:string,confidence:double,time_expression:string>>"
    each = rows.select(*extra, F.explode(F.from_json(listed, item)).alias("r")).select(*extra, "r.*")
    kind = F.coalesce("type", F.lit("key_fact"))
    texts = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("content", "content"), ("citation", "quote"), ("context", "context"))]
    return each.where(F.col("content").isNotNull() & kind.isin(S.TYPES)).select(*extra, kind.alias("obj_type"), *texts, F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.col("time_expression").alias("event_time_raw"))


def gleaned(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both passes of an extraction (conv_id, turn_id, content, context, ...): of the second what the first has not, its context marked."""
    new = without_repeats(second, first).withColumn("context", F.concat(F.lit("[gleaned] "), F.coalesce("context", F.lit(""))))
    return first.unionByName(new.select(first.columns))


def merged_times(artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, id, event_time, event_time_raw, added): artifacts with their times filled in from the session, and the found time artifacts
    (conv_id, turn_id, id, expression, event_time) of which the conversation's turn has neither the expression nor the time.

    Found ones are not compared with each other.
    """
    own = with_sessions(artifacts)
    filled = own.select("conv_id", "turn_id", "id", T.resolved(F.col("event_time_raw"), T.session_time(F.col("session"))).alias("event_time"), "event_time_raw")
    raws = filled.where("event_time_raw is not null").select("conv_id", "turn_id", F.lower("event_time_raw").alias("k")).distinct()
    times = filled.where("event_time is not null").select("conv_id", "turn_id", F.lower("event_time").alias("k")).distinct()
    new = found.withColumn("k", F.lower("expression")).join(raws, ["conv_id", "turn_id", "k"], "left_anti").withColumn("k", F.lower("event_time")).join(times, ["conv_id", "turn_id", "k"], "left_anti")
    return filled.select("conv_id", "id", "event_time", "event_time_raw", F.lit(False).alias("added")).unionByName(new.select("conv_id", "id", "event_time", F.col("expression").alias("event_time_raw"), F.lit(True).alias("added")))


def resolve_by_vectors(references: DataFrame, candidates: DataFrame, floor: float = 0.5) -> DataFrame:
    """(ref_id, resolved_id, confidence): the candidate of greatest cosine, of the hinted type if the conversation has any; null below ``floor``.

    ``vec`` on both sides, unit length.
    """
    return _by_vectors(resolving.best(references, candidates, False, True), floor)


def _by_vectors(best: DataFrame, floor: float = 0.5) -> DataFrame:
    score = F.col("v.confidence")
    return best.select("ref_id", F.when(score >= floor, F.col("v.id")).alias("resolved_id"), F.coalesce(F.greatest(score, F.lit(0.0)), F.lit(0.0)).alias("confidence"))


def resolve_by_both(by_keywords: DataFrame, by_vectors: DataFrame) -> DataFrame:
    """(ref_id, resolved_id, confidence): both confidences together where the resolvers agree, else the surer one, the vectors' if they are equal."""
    k = by_keywords.select("ref_id", F.col("resolved_id").alias("k"), F.coalesce("confidence", F.lit(0.0)).alias("kc"))
    v = by_vectors.select("ref_id", F.col("resolved_id").alias("v"), F.col("confidence").alias("vc"))
    agree, surer = F.col("k") == F.col("v"), F.col("vc") >= F.col("kc")
    both = k.join(v, "ref_id")
    return both.select("ref_id", F.when(agree, F.col("k")).when(surer, F.col("v")).otherwise(F.col("k")).alias("resolved_id"), F.round(F.when(agree, F.least(F.lit(1.0), F.col("kc") + F.col("vc"))).when(surer, F.col("vc")).otherwise(F.col("kc")), 6).alias("confidence"))


def resolve(references: DataFrame, candidates: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """References to artifacts by 'keyword', 'embedding' or 'hybrid'; another strategy is an error."""
    return resolve_each(references, candidates, [strategy])[strategy]


def resolve_each(references: DataFrame, candidates: DataFrame, strategies: list[str]) -> dict[str, DataFrame]:
    """The results of ``resolve`` by strategy. Candidates are searched once; what several results read is written to the shared folder."""
    for s in strategies:
        if s not in ("keyword", "embedding", "hybrid"):
            raise ValueError(f"unknown resolver {s!r}")
    best = resolving.best(references, candidates, strategies != ["embedding"], strategies != ["keyword"])
    if strategies not in (["keyword"], ["embedding"]):
        best = materialize(best, "resolved")
    k, v = _by_keywords(best), _by_vectors(best)
    return {s: {"keyword": k, "embedding": v}[s] if s != "hybrid" else resolve_by_both(k, v) for s in strategies}
