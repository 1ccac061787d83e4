"""All questions against all candidates of their conversation, block by block, with a partial top k.

A conversation's candidates are spread over blocks of about BLOCK_ROWS by a hash of their
ids, so a conversation that holds a tenth of all rows is many tasks; its questions visit
each block. In a block the cosines of all its questions are one matrix product, and BM25
reads the postings of the asked terms only. A block sends on what can still be among the
best, so what is shuffled afterwards is a small multiple of questions times blocks, not
questions times candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK_ROWS = 2_048
SLACK = 1e-5  # more than rounding to six places can move a score


def corpus_of(docs: DataFrame) -> DataFrame:
    """(conv_id, n, avgdl): the number of candidates and their mean number of tokens."""
    return docs.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def weighted_terms(docs: DataFrame, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(conv_id, q_id, terms, weights): the asked terms with their idf, repeats counted.

    A term in more than half of the candidates gets EPSILON times the mean idf of all terms.
    """
    df = docs.select("conv_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("conv_id", "term").agg(F.count("*").alias("df"))
    raw = df.join(corpus, "conv_id").select("conv_id", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.groupBy("conv_id").agg(F.avg("idf").alias("mean_idf"))
    asked = questions.select("conv_id", "q_id", F.explode("tokens").alias("term")).groupBy("conv_id", "q_id", "term").agg(F.count("*").alias("times"))
    found = asked.join(raw, ["conv_id", "term"]).join(mean, "conv_id")
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    pairs = found.groupBy("conv_id", "q_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("times") * idf).alias("w")))).alias("t"))
    return pairs.select("conv_id", "q_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))


class _Block:
    """The candidates of one block: vectors, and postings by term."""

    def __init__(self, rows: pa.Table, lexical: bool, dim: int) -> None:
        self.ids = np.array(rows.column("id").to_pylist(), object)
        order = np.argsort(self.ids.astype(str), kind="stable")
        rows, self.ids = rows.take(pa.array(order)), self.ids[order]
        self.vectors = _matrix(rows.column("vec"), dim) if dim else None
        self.codes: dict[str, int] = {}
        n = len(self.ids)
        if lexical:
            tokens = rows.column("terms").combine_chunks()
            sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            encoded = tokens.flatten().dictionary_encode()
            self.codes = {t: k for k, t in enumerate(encoded.dictionary.to_pylist())}
            at, tf = np.unique(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
            self.doc = at % n
            self.start = np.searchsorted(at // n, np.arange(len(self.codes) + 1))
            self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / float(rows.column("avgdl")[0].as_py() or 1)))

    def lexical(self, terms: list[str], weights: list[float]) -> np.ndarray:
        raw = np.zeros(len(self.ids))
        for term, w in zip(terms, weights):
            k = self.codes.get(term)
            if k is not None:
                raw[self.doc[self.start[k] : self.start[k + 1]]] += w * self.part[self.start[k] : self.start[k + 1]]
        return raw


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores, rounded; of equals the first."""
    return np.argsort(-np.round(score, 6), kind="stable")[:k]


def _undominated(sem: np.ndarray, raw: np.ndarray, weight: float, k: int) -> np.ndarray:
    """Rows that can be among the k best of weight * sem + (1 - weight) * raw / best, whatever ``best`` is from this block's own upwards.

    Such a score is linear in 1 / best, so a row that k others beat at both ends of its range
    is never among the k best. Rows equal in both parts count in order.
    """
    top = raw.max(initial=0.0)
    if top <= 0:
        return _best(sem, k)
    far, own = weight * sem, weight * sem + (1 - weight) * raw / top
    rivals = np.unique(np.concatenate([_best(far + t * (own - far), k) for t in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    beaten = (far[rivals][None, :] > far[:, None] + SLACK) & (own[rivals][None, :] > own[:, None] + SLACK)
    beaten |= (far[rivals][None, :] == far[:, None]) & (own[rivals][None, :] == own[:, None]) & (rivals[None, :] < np.arange(len(sem))[:, None])
    return np.flatnonzero(beaten.sum(axis=1) < k)


def _score(k: int, method: str, weight: float, dim: int):
    names = ["conv_id", "q_id", "doc_id", "sem", "raw", "top"]

    def answers(conv: str, block: _Block, asked: pa.RecordBatch) -> pa.RecordBatch:
        cosines = _matrix(asked.column("vec"), dim) @ block.vectors.T if method != "bm25" else None
        ids, docs, sems, raws, tops = [], [], [], [], []
        for r, (q, terms, weights) in enumerate(zip(asked.column("id").to_pylist(), asked.column("terms").to_pylist(), asked.column("weights").to_pylist())):
            sem = cosines[r] if cosines is not None else np.zeros(len(block.ids))
            raw = block.lexical(terms or [], weights or []) if method != "semantic" else np.zeros(len(block.ids))
            if method == "hybrid":
                rows = _undominated(sem, raw, weight, k)
            elif method == "bm25":
                some = np.flatnonzero(raw > 0)
                # rounding follows the division by a best score that only all blocks tell: near ties stay
                rows = some[raw[some] >= np.partition(raw[some], -k)[-k] * (1 - SLACK) - SLACK] if len(some) > k else some
            else:
                rows = _best(sem, k)
            ids += [q] * len(rows)
            docs += block.ids[rows].tolist()
            sems.append(sem[rows])
            raws.append(raw[rows])
            tops.append(np.full(len(rows), raw.max(initial=0.0)))
        numbers = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64()) for x in (sems, raws, tops)]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(docs, pa.string()), *numbers], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, block = None, None
        for b in batches:
            keys = list(zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("is_q").to_pylist()))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                piece, (conv, number, is_q) = b.slice(lo, hi - lo), keys[lo]
                if (conv, number) != current:
                    current, held, block = (conv, number), [], None
                if not is_q:
                    held.append(piece)
                    continue
                if block is None and held:
                    block, held = _Block(pa.Table.from_batches(held), method != "semantic", 0 if method == "bm25" else dim), []
                if block is not None:
                    for first in range(0, piece.num_rows, 512):
                        yield answers(conv, block, piece.slice(first, 512))

    return run


def scored(docs: DataFrame, questions: DataFrame, k: int, method: str, weight: float = 0.7, dim: int = 16, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """(conv_id, q_id, doc_id, score): of every question all candidates that can be among its k best by 'semantic', 'bm25' or 'hybrid'.

    Candidates are (conv_id, doc_id, vec, tokens), questions (conv_id, q_id, vec, tokens); vectors
    have length one and ``dim`` numbers. ``stored`` says that the candidates are a table already. Ids that are null take no part.
    """
    docs, questions = docs.where("conv_id is not null and doc_id is not null"), questions.where("conv_id is not null and q_id is not null")
    if method == "bm25":  # no vector is computed or shuffled
        nothing = F.lit(None).cast("array<double>")
        docs, questions = docs.withColumn("vec", nothing), questions.withColumn("vec", nothing)
    if method != "semantic" and not stored:  # the statistics and the blocks read the same tokens: they are made once
        docs = materialize(docs.select("conv_id", "doc_id", "vec", "tokens"), "docs")
    corpus = corpus_of(docs)
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    of_docs = docs.join(corpus, "conv_id").select("conv_id", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.lit(False).alias("is_q"), F.col("doc_id").cast("string").alias("id"), "vec", F.col("tokens").alias("terms"), F.lit(None).cast("array<double>").alias("weights"), "avgdl")
    asked = questions.join(weighted_terms(docs, questions, corpus), ["conv_id", "q_id"], "left") if method != "semantic" else questions.withColumns({"terms": F.lit(None).cast("array<string>"), "weights": F.lit(None).cast("array<double>")})
    of_questions = asked.join(corpus, "conv_id").select("conv_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("is_q"), F.col("q_id").cast("string").alias("id"), "vec", "terms", "weights", "avgdl")
    laid = of_docs.unionByName(of_questions).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "is_q")
    found = laid.mapInArrow(_score(k, method, weight, dim), "conv_id string, q_id string, doc_id string, sem double, raw double, top double")
    if method == "semantic":
        return found.select("conv_id", "q_id", "doc_id", F.round("sem", 6).alias("score"))
    known = found.withColumn("best", F.max("top").over(Window.partitionBy("conv_id", "q_id")))
    lexical = F.when((F.col("best") > 0) & (F.col("raw") > 0), F.round(F.col("raw") / F.col("best"), 6))
    if method == "bm25":
        return known.select("conv_id", "q_id", "doc_id", lexical.alias("score")).where("score is not null")
    total = F.round(weight * F.round("sem", 6) + (1 - weight) * F.coalesce(lexical, F.lit(0.0)), 7)
    return known.select("conv_id", "q_id", "doc_id", total.alias("score")).where("score > 0")
