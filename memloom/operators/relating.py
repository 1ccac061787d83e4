"""Pairs of a conversation's rows, the later with the earlier, by blocks: cosines as matrix products, shared words only where they decide.

A conversation's rows are spread over blocks of about BLOCK_ROWS by a hash of their ids, and
every two blocks are one task; a conversation of one block is one task of its own. Only
pairs that hold are ever written out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1_536
ONE_BY_ONE = 20_000  # undecided pairs up to which word sets are compared pair by pair: the cheaper way there, with the same result


def _postings(lists: list[list[str]]) -> dict[str, list[int]]:
    at = defaultdict(list)
    for k, words in enumerate(lists):
        for w in words:
            at[w].append(k)
    return at


def _share(new: list[list[str]], old: list[list[str]], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Of each pair (row, column) whether the two lists share a word."""
    if len(rows) <= ONE_BY_ONE:
        sets = {k: set(new[k]) for k in set(rows.tolist())}
        return np.array([not sets[a].isdisjoint(old[b]) for a, b in zip(rows.tolist(), cols.tolist())], bool)
    shared, held, other = np.zeros((len(new), len(old)), bool), _postings(new), _postings(old)
    for w in held.keys() & other.keys():
        shared[np.ix_(held[w], other[w])] = True
    return shared[rows, cols]


def _related(reference: float, floor: float, dim: int):
    def between(new: dict, old: dict) -> tuple[np.ndarray, np.ndarray]:
        sim = np.floor(new["vec"] @ old["vec"].T * 1e6 + 0.5)
        earlier = old["turn"][None, :] < new["turn"][:, None]
        sure = earlier & (sim >= round(reference * 1e6))
        rows, cols = np.nonzero(earlier & ~sure & (sim >= round(floor * 1e6)))
        keep = _share(new["all"], old["content"], rows, cols)
        a, b = np.nonzero(sure)
        return new["id"][np.concatenate([a, rows[keep]])], old["id"][np.concatenate([b, cols[keep]])]

    def side(t: pa.Table, which: int) -> dict:
        t = t.filter(pa.compute.equal(t.column("side"), which))
        turn = t.column("turn_id").cast(pa.float64()).to_numpy(zero_copy_only=False)  # a missing turn is NaN: earlier than none
        vec = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return {"id": np.array(t.column("id").to_pylist(), object), "turn": turn, "vec": vec, "all": t.column("kw_all").to_pylist(), "content": t.column("kw_content").to_pylist()}

    def cell(key: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        first = side(t, 0)
        if key[1] == key[2]:
            found = [between(first, first)]
        else:
            second = side(t, 1)
            found = [between(first, second), between(second, first)]
        for src, dst in found:
            for lo in range(0, len(src), 50_000):
                a, b = src[lo : lo + 50_000].tolist(), dst[lo : lo + 50_000].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["conv_id", "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        current, held = None, []
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("conv_id", "i", "j")]))
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if keys[lo] != current:
                    if held:
                        yield from cell(current, held)
                    current, held = keys[lo], []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from cell(current, held)

    return run


def references(f: DataFrame, reference: float, floor: float, dim: int = 16, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, src, dst): rows (conv_id, id, turn_id, vec, kw_all, kw_content) with those of earlier turns whose cosine, rounded to six
    places, is at least ``reference``, or at least ``floor`` where a word of ``kw_all`` is in the earlier one's ``kw_content``."""
    rows = f.where("conv_id is not null")
    # only conversations of several blocks are listed: at most one row for every block_rows rows
    several = rows.groupBy("conv_id").count().where(F.col("count") > block_rows).select("conv_id", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    n = F.coalesce("n", F.lit(1))
    placed = rows.join(F.broadcast(several), "conv_id", "left").withColumn("b", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    i, j = F.least("b", "k"), F.greatest("b", "k")
    laid = placed.select("conv_id", i.alias("i"), j.alias("j"), (F.col("b") != i).cast("int").alias("side"), F.col("id").cast("string").alias("id"), "turn_id", "vec", "kw_all", "kw_content")
    return laid.repartition("conv_id", "i", "j").sortWithinPartitions("conv_id", "i", "j").mapInArrow(_related(reference, floor, dim), "conv_id string, src string, dst string")
