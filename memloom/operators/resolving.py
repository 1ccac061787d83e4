"""All references against all candidates of their conversation, block by block: the best candidate by words, by vectors, or both in one pass.

A conversation's candidates are spread over blocks of at most about BLOCK_ROWS by a hash of
their ids; its references visit each block. In a block, words are looked up in postings and
cosines are one matrix product, and only rows that can still be the best are sent on: no pair
of reference and candidate is shuffled, however many share a word or a type. Conversations of
at most SMALL candidates, nearly all of them, are compared row by row, which costs less there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192
SMALL = 64
NO_TURN = 1 << 31  # a missing turn sorts last
NEAR = 2e-6  # more than rounding to six places can move a score
_FOUND = "conv_id string, ref_id string, how string, cand string, turn_id long, score double"


def _leading(x: np.ndarray) -> np.ndarray:
    """Places of the values that may be the greatest when rounded to six places, of equal values the first.

    Spark rounds; a value so close to a half that the rounding could go either way stays beside the surely greatest.
    """
    if len(x) == 1:
        return np.zeros(1, np.int64)
    low, high = np.floor(x * 1e6 + 0.499), np.floor(x * 1e6 + 0.501)
    near = np.flatnonzero(high >= low.max())
    sure = near[low[near] == high[near]]
    unsure = near[low[near] != high[near]]
    return np.concatenate([sure[:1], unsure[np.unique(x[unsure], return_index=True)[1]]]) if len(unsure) else sure[:1]


class _Block:
    """The candidates of one block: by turn and id with postings by word, by id with vectors."""

    def __init__(self, rows: pa.Table, words: bool, dim: int) -> None:
        ids, turns = np.array(rows.column("id").to_pylist(), object), rows.column("turn_id")
        by_id = np.argsort(ids.astype(str), kind="stable")
        kinds = np.array([k if k is not None else "" for k in rows.column("kind").to_pylist()], object)
        missing = turns.is_null().to_numpy(zero_copy_only=False) if isinstance(turns, pa.Array) else turns.is_null().combine_chunks().to_numpy(zero_copy_only=False)
        turn = np.where(missing, NO_TURN, turns.fill_null(0).to_numpy()).astype(np.int64)
        if words:
            order = by_id[np.argsort(turn[by_id], kind="stable")]
            self.ids, self.turn, self.kinds = ids[order], turn[order], kinds[order]
            with np.errstate(divide="ignore"):
                # a missing turn makes the score that of the cap, as LEAST without its null does
                self.early = np.where(self.turn == NO_TURN, np.inf, 0.1 / (1 + 0.1 * self.turn.astype(float)))
            listed = rows.column("words").combine_chunks().take(pa.array(order))
            sizes = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            encoded = listed.flatten().dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.codes = {t: k for k, t in enumerate(encoded.dictionary.to_pylist())}
            self.doc = np.repeat(np.arange(len(order)), sizes)[np.argsort(codes, kind="stable")]
            self.start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.codes)))])
            self.without: dict[str | None, np.ndarray] = {}
        if dim:
            vectors = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            self.sorted_ids, self.vectors, self.sorted_kinds = ids[by_id], vectors[by_id], kinds[by_id]
            self.of_kind: dict[str | None, np.ndarray] = {}

    def score(self, rows: np.ndarray, share: np.ndarray | float, hint: str | None) -> np.ndarray:
        typed = np.where(self.kinds[rows] == hint, 0.3, 0.0) if hint else 0.0
        return np.minimum(1.0, typed + 0.5 * share + self.early[rows])

    def by_words(self, words: list[str], hint: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be the best, and their scores."""
        if hint not in self.without:
            self.without[hint] = self.score(np.arange(len(self.ids)), 0.0, hint)
        x = self.without[hint]
        at = [k for w in words if (k := self.codes.get(w)) is not None]
        if at:
            shared = np.bincount(np.concatenate([self.doc[self.start[k] : self.start[k + 1]] for k in at]), minlength=len(x))
            x = np.minimum(1.0, x + shared * (0.5 / len(words)))
        near = np.flatnonzero(x >= x.max() - NEAR)
        exact = self.score(near, shared[near] / len(words) if at else 0.0, hint)
        best = _leading(exact)
        return near[best], exact[best]

    def kind_rows(self, hint: str | None) -> np.ndarray:
        if hint not in self.of_kind:
            self.of_kind[hint] = np.flatnonzero(self.sorted_kinds == hint)
        return self.of_kind[hint]


class _Found:
    """Rows for the next batch."""

    def __init__(self) -> None:
        self.columns: tuple[list, ...] = ([], [], [], [], [], [])

    def add(self, *row) -> None:
        for c, x in zip(self.columns, row):
            c.append(x)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
        columns, self.columns = self.columns, ([], [], [], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "ref_id", "how", "cand", "turn_id", "score"])


def _early(turn: int | None) -> float:
    return float("inf") if turn is None or 1 + 0.1 * turn == 0 else 0.1 / (1 + 0.1 * turn)


def _one_by_one(conv: str, cands: list[tuple], cand_vectors: np.ndarray | None, refs: list[tuple], ref_vectors: np.ndarray | None, words: bool, floor: float, found: _Found) -> None:
    """Candidates (id, kind, turn, set of words) and references (id, hint, -, words) of a small conversation."""
    if words:
        sides = [(i, k, NO_TURN if t is None else t, _early(t), w) for i, k, t, w in cands]
        for ref, hint, _, own in refs:
            n, asked = len(own), set(own)
            scores = [min(1.0, (0.3 if hint is not None and k == hint else 0.0) + 0.5 * (len(w & asked) / n if n else 0.0) + early) for _, k, _, early, w in sides]
            top = max(scores)
            if top >= floor - 1e-5:
                for (i, _, t, _, _), x in zip(sides, scores):
                    if x >= top - NEAR:
                        found.add(conv, ref, "words", i, t, x)
    if cand_vectors is not None:
        for (ref, hint, _, _), cosines in zip(refs, (ref_vectors @ cand_vectors.T).tolist()):
            own = [(x, c[0]) for x, c in zip(cosines, cands) if hint is not None and c[1] == hint]
            how = "typed" if own else "any"
            own = own or [(x, c[0]) for x, c in zip(cosines, cands)]
            top = max(x for x, _ in own)
            for x, i in own:
                if x >= top - NEAR:
                    found.add(conv, ref, how, i, None, x)


def _in_block(conv: str, block: _Block, asked: pa.RecordBatch, words: bool, dim: int, floor: float, found: _Found) -> None:
    refs, hints = asked.column("id").to_pylist(), asked.column("kind").to_pylist()
    if words:
        for ref, hint, own in zip(refs, hints, asked.column("words").to_pylist()):
            rows, x = block.by_words(own, hint or None)
            if x.max() >= floor - 1e-5:
                for r, y in zip(rows.tolist(), x.tolist()):
                    found.add(conv, ref, "words", block.ids[r], int(block.turn[r]), y)
    if dim:
        vectors = _matrix(asked.column("vec"), dim)
        for hint in set(hints):
            rows = block.kind_rows(hint) if hint else np.zeros(0, np.int64)
            how = "typed" if len(rows) else "any"
            if how == "any":
                rows = np.arange(len(block.sorted_ids))
            mine = [k for k, h in enumerate(hints) if h == hint]
            cosines = vectors[mine] @ block.vectors[rows].T
            near = cosines >= cosines.max(axis=1, keepdims=True) - NEAR
            for k, own, some in zip(mine, cosines, near):
                at = np.flatnonzero(some)
                for r in at[_leading(own[at])].tolist():
                    found.add(conv, refs[k], how, block.sorted_ids[rows[r]], None, float(own[r]))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _answers(words: bool, dim: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, current, held, n, block = _Found(), None, [], 0, None
        for b in batches:
            columns = [b.column(c).to_pylist() if c != "words" or words else [[]] * b.num_rows for c in ("id", "kind", "turn_id", "words")]
            vectors = _matrix(b.column("vec"), dim) if dim else None
            keys = list(zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("is_ref").to_pylist()))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                conv, number, is_ref = keys[lo]
                if (conv, number) != current:
                    current, held, n, block = (conv, number), [], 0, None
                rows = list(zip(*[c[lo:hi] for c in columns]))
                own = vectors[lo:hi] if dim else None
                if not is_ref:
                    held.append((rows, own, b.slice(lo, hi - lo)))
                    n += hi - lo
                elif n > SMALL:
                    block = block or _Block(pa.Table.from_batches([x[2] for x in held]), words, dim)
                    for first in range(lo, hi, 256):
                        _in_block(conv, block, b.slice(first, min(256, hi - first)), words, dim, floor, found)
                elif n:
                    cands = [(i, k, t, set(w)) for rs, _, _ in held for i, k, t, w in rs]
                    _one_by_one(conv, cands, np.concatenate([v for _, v, _ in held]) if dim else None, rows, own, words, floor, found)
            yield found.batch()

    return run


def best(references: DataFrame, candidates: DataFrame, words: bool, vectors: bool, floor: float = 0.3, dim: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, ref_id, k, v): of every reference the best candidate by words, type and turn, k (id, confidence), and the one
    of greatest cosine, v (id, confidence), of the hinted type if the conversation has any.

    References are (conv_id, ref_id, hint, words, vec), candidates (conv_id, id, obj_type, turn_id, words, vec); ``words`` or
    ``vec`` is read only if asked for. k is null below ``floor``, v where the conversation has no candidate.
    """
    refs, cands = references.where("conv_id is not null and ref_id is not null"), candidates.where("conv_id is not null and id is not null")
    # only conversations of several blocks are listed: at most one row for every block_rows candidates
    several = cands.groupBy("conv_id").count().where(F.col("count") > block_rows).select("conv_id", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(1))
    own = [F.array_distinct("words").alias("words")] if words else []
    own += [F.col("vec")] if vectors else []
    laid = cands.join(F.broadcast(several), "conv_id", "left").select("conv_id", F.pmod(F.xxhash64("id"), n).cast("int").alias("block"), F.lit(False).alias("is_ref"), F.col("id").cast("string").alias("id"), F.col("obj_type").alias("kind"), F.col("turn_id").cast("long").alias("turn_id"), *own)
    asked = refs.join(F.broadcast(several), "conv_id", "left").select("conv_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(True).alias("is_ref"), F.col("ref_id").cast("string").alias("id"), F.col("hint").alias("kind"), F.lit(None).cast("long").alias("turn_id"), *own)
    found = laid.unionByName(asked).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "is_ref").mapInArrow(_answers(words, dim if vectors else 0, floor), _FOUND)
    score = F.round("score", 6)
    by_words = F.when((F.col("how") == "words") & (score >= floor), F.struct((-score).alias("less"), F.col("turn_id"), F.col("cand")))
    by_vectors = F.when(F.col("how") != "words", F.struct((F.col("how") == "any").alias("any"), (-score).alias("less"), F.col("cand")))
    least = found.groupBy("conv_id", "ref_id").agg(F.min(by_words).alias("k"), F.min(by_vectors).alias("v"))
    shown = [F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.cand").alias("id"), (-F.col(f"{c}.less")).alias("confidence"))).alias(c) for c in ("k", "v")]
    return references.select("conv_id", "ref_id").join(least.select("conv_id", "ref_id", *shown), ["conv_id", "ref_id"], "left")
