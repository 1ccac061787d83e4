"""Places for models: extraction, embedding, reranking and answer judging, each a function over Arrow batches.

A backend is any callable on lists; the ones here work without a network. Calls are
retried with growing pauses inside the task, before Spark's own task retry.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators import extraction as E
from memloom.operators import retrieval as R


# fixed values: what tells an error that may pass: status codes, and words of its message
PASSING_CODES = {429, 500, 502, 503, 504}
PASSING_WORDS = ["rate limit", "too many requests", "timeout", "timed out", "connection", "temporarily", "overloaded", "unavailable"]


def is_passing(error: BaseException) -> bool:
    """Whether a call may succeed if it is repeated: by the error's class, its status code, or its message."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    code = getattr(error, "status_code", getattr(error, "code", None))
    if isinstance(code, int):
        return code in PASSING_CODES
    said = str(error).lower()
    return any(w in said for w in PASSING_WORDS)


def retried(call: Callable, tries: int = 3, pause: float = 0.5, longest: float = 30.0) -> Callable:
    """The call again after an error that may pass, up to ``tries`` times, with growing pauses of random length; other errors are raised at once."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as error:
                if k + 1 == tries or not is_passing(error):
                    raise
                time.sleep(min(longest, pause * 2**k) * random.uniform(0.5, 1.0))

    return run


def embed(rows: DataFrame, key: str, text: str, backend: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(key, vec) by an embedding backend; blank and null texts get null, so rows and vectors stay aligned."""
    call = retried(backend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            full = [k for k, t in enumerate(texts) if t and t.strip()]
            out: list = [None] * len(texts)
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                for k, v in zip(part, call([texts[k] for k in part])):
                    out[k] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["key", "vec"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key string, vec array<float>")


def rated(hits: DataFrame, backend: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """(conv_id, q_id, doc_id, score): a backend's numbers for the candidates of each question, one call per question; null texts are empty."""
    call = retried(backend)
    keys = ["conv_id", "q_id", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            scores = [float(x) for x in call(held[0][3] or "", [h[4] or "" for h in held])]
            return pa.RecordBatch.from_arrays([*[pa.array([h[k] for h in held], pa.string()) for k in range(3)], pa.array(scores, pa.float64())], names=[*keys, "score"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in (*keys, "question", "content")]):
                if held and held[0][:2] != row[:2]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    asked = hits.select(*keys, "question", "content").repartition("conv_id", "q_id").sortWithinPartitions(*keys)
    return asked.mapInArrow(run, "conv_id string, q_id string, doc_id string, score double")


def judged(hits: DataFrame, backend: Callable[[str, list[str]], list[float]], most: int = 5, least: float = 0.3) -> DataFrame:
    """Results filtered by a rating of 0 to 10 per candidate: at least ``least`` after division by 10, best first, at most ``most`` per question."""
    return R.ranked(rated(hits, lambda q, docs: [min(10.0, max(0.0, float(x))) / 10 for x in backend(q, docs)]).where(F.col("score") >= least), most)


def reranked(hits: DataFrame, backend: Callable[[str, list[str]], list[float]], most: int = 5) -> DataFrame:
    """Results in the order of a reranking backend's scores, at most ``most`` per question."""
    return R.ranked(rated(hits, backend).withColumn("score", F.round("score", 6)), most)


def answer_judged(rows: DataFrame, backend: Callable[[str, str, str], str | None], fallback: str) -> DataFrame:
    """Adds ``verdict``: 1 for an answer that a model calls CORRECT, else 0; the column ``fallback`` where the call gives nothing or fails.

    ``rows`` has question, answer and ground_truth.
    """
    call = retried(backend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[float | None] = []
            for q, a, t in zip(*[b.column(c).to_pylist() for c in ("question", "answer", "ground_truth")]):
                try:
                    said = call(q or "", a or "", t or "")
                except Exception:
                    said = None
                out.append(None if said is None else float(said.strip().upper() == "CORRECT"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "verdict"])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, typed + ", verdict double").withColumn("verdict", F.coalesce("verdict", F.col(fallback).cast("double")))


def shared_word_rating(question: str, docs: list[str]) -> list[float]:
    """A rating without a model: ten times the share of the question's words in the candidate."""
    q = set(question.lower().split())
    return [10 * len(q & set(d.lower().split())) / len(q) if q else 0.0 for d in docs]


def model_extractor(backend: Callable[[str, list[str]], str], known: DataFrame | None = None, hints: int = 10) -> Callable[[DataFrame], DataFrame]:
    """An extractor that shows a model each turn and the beginnings of the conversation's last ``hints`` artifacts, and reads the JSON it writes.

    An error that does not pass gives the turn no artifacts.
    """
    call = retried(backend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for user, said, shown in zip(*[b.column(c).to_pylist() for c in ("user_text", "assistant_text", "shown")]):
                try:
                    out.append(call(f"{user or ''}\n{said or ''}", shown or []))
                except Exception:
                    out.append("[]")
            kept = ["conv_id", "turn_id", "entry_id"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.string())], names=[*kept, "said"])

    def extract(turns: DataFrame) -> DataFrame:
        rows = turns.select("conv_id", "turn_id", "entry_id", "user_text", "assistant_text")
        if known is None:
            rows = rows.withColumn("shown", F.array().cast("array<string>"))
        else:
            w = Window.partitionBy("conv_id").orderBy(F.desc("turn_id"), F.desc("id"))
            last = known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= hints).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("content", 1, 100).alias("c")))), lambda x: x["c"]).alias("shown"))
            rows = rows.join(last, "conv_id", "left")
        said = rows.mapInArrow(run, "conv_id string, turn_id int, entry_id long, said string")
        return E.parsed(said, "said", ["conv_id", "turn_id", "entry_id"])

    return extract


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": E.rule_artifacts}


def extract(turns: DataFrame, backend: str | Callable[[DataFrame], DataFrame] = "rules") -> DataFrame:
    """Artifacts of turns by a named extractor or a given one; unknown names are an error."""
    if callable(backend):
        return backend(turns)
    if backend not in EXTRACTORS:
        raise ValueError(f"unknown extractor {backend!r}")
    return EXTRACTORS[backend](turns)
