"""Problem 4: the k most similar vectors of every vector, by cosine, within an accuracy loss.

Method: inverted multi-index. Unit vectors are cut into two halves, each half quantised by
its own centroids; a pair of centroids is a cell. For each query the cells are traversed
in order of summed distance with a heap until they hold ``probe`` vectors, or until
``cells`` of them are visited, and the vectors found there are reranked by their exact
cosine. Centroids are fitted on a sample of at most SAMPLE vectors; every vector is
indexed, and every vector is a query unless ``queries`` says which are.

Two ways of use. With ``cells`` and ``least`` the search is for neighbours of at least that
cosine: a fixed number of small cells is visited, so the work per query does not grow with
the collection; near vectors share a cell or lie in the next ones. Without them the k
nearest are wanted however far they are; where vectors hardly cluster that needs a share of
the collection (PROBE_SHARE), so such a search takes a stated set of queries.

Cells lie together in blocks of about BLOCK_ROWS vectors. Centroids are numbered by
recursive bisection along principal axes, so neighbouring cells mostly lie in one block,
and a vector is sent only to the blocks whose cells it visits. A cell with more vectors than
a block is spread over several, each of which its visitors see. Equal vectors form one
class: it is indexed once, with its k + 1 smallest keys, so a vector that a third of all
records share costs one entry per input batch; members read the list of their class.

Measured recall against brute force: see the README.

Ties in cosine go to the smaller key. Edge cases: null vectors, all-zero ones, ones of
another length than ``dim`` and ones holding NaN or infinity take no part; a repeated key
counts once; with k or fewer other vectors all of them come out; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import keep

SAMPLE, BLOCK_ROWS, MOST_CENTROIDS, LLOYD = 32_768, 16_384, 512, 12
PROBE, PROBE_SHARE, CELL_ROWS = 1_536, 0.045, 64  # candidates of a query for the k nearest: PROBE and this share of all vectors
NEAR_CELLS, NEAR_ROWS = 6, 16  # cells visited for near vectors, and their mean size


def _unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable entries."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((flat**2).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (flat[good] / norm[good, None]).astype(np.float32)


def _usable(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows, unit = _unit_rows(b.column(1), dim)
            raw = [u.tobytes() for u in unit]
            keys = [xxhash.xxh64_intdigest(r) - (1 << 63) for r in raw]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), pa.array(keys, pa.int64()), b.column(2).take(taken), pa.array(raw, pa.binary())], names=["key", "ckey", "asks", "vec"])

    return run


def _matrix(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dim)


def fit_centroids(points: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means from a seeded start."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:count]].copy()
    for _ in range(LLOYD):
        near = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres, np.float64)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        full = sizes > 0
        centres[full] = (sums[full] / sizes[full, None]).astype(np.float32)
    return centres[_bisected(centres, np.arange(len(centres)))]


def _bisected(points: np.ndarray, rows: np.ndarray) -> list[int]:
    """An order in which neighbours in number are neighbours in space: halves along the principal axis, each halved again."""
    if len(rows) < 2:
        return rows.tolist()
    spread = points[rows] - points[rows].mean(axis=0)
    by_axis = rows[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
    half = len(rows) // 2
    return _bisected(points, by_axis[:half]) + _bisected(points, by_axis[half:])


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T


class Index:
    """Centroids of both halves, vectors per cell, and the blocks that hold each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second
        self.counts = np.zeros(len(first) * len(second), np.int64)
        self.block = np.zeros(len(self.counts), np.int32)  # the first block of each cell
        self.parts = np.ones(len(self.counts), np.int32)  # and the number of its blocks
        self.n_blocks = 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        half = self.first.shape[1]
        return _distances(unit[:, :half], self.first).argmin(axis=1) * len(self.second) + _distances(unit[:, half:], self.second).argmin(axis=1)

    def lay_out(self, counts: dict[int, int], block_rows: int) -> None:
        for cell, n in counts.items():
            self.counts[cell] = n
        block, used = 0, 0
        for cell in np.flatnonzero(self.counts):
            n = int(self.counts[cell])
            if used and used + n > block_rows:
                block, used = block + 1, 0
            parts = max(1, -(-n // block_rows))  # a cell larger than a block gets blocks of its own
            self.block[cell], self.parts[cell] = block, parts
            block, used = block + parts - 1, used + n if parts == 1 else block_rows
        self.n_blocks = block + 1

    def blocks_of(self, cell: int) -> range:
        return range(self.block[cell], self.block[cell] + self.parts[cell])

    def visits(self, unit: np.ndarray, probe: int, most: int | None = None) -> list[list[int]]:
        """For each vector the non-empty cells in order of summed distance that hold ``probe`` vectors, at most ``most`` of them."""
        most = most or len(self.counts)
        half, width = self.first.shape[1], len(self.second)
        a, b = _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)
        order_a, order_b = np.argsort(a, axis=1), np.argsort(b, axis=1)
        a, b = np.take_along_axis(a, order_a, 1).tolist(), np.take_along_axis(b, order_b, 1).tolist()
        order_a, order_b, counts = (order_a * width).tolist(), order_b.tolist(), self.counts.tolist()
        out = []
        for da, db, oa, ob in zip(a, b, order_a, order_b):
            heap, found, got = [(da[0] + db[0], 0, 0)], [], 0
            while heap and got < probe and len(found) < most:
                _, i, j = heapq.heappop(heap)
                cell = oa[i] + ob[j]
                if counts[cell]:
                    found.append(cell)
                    got += counts[cell]
                if j + 1 < len(db):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(da):
                    heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            out.append(found)
        return out


def _with_cells(index, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.value.cells(_matrix(b.column("vec"), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32), pa.int32())], names=["cell"])

    return run


def _route(index, dim: int, k: int, probe: int, most: int | None):
    """For each different vector of a batch one row per block: as a member with its keys, as a visitor with its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            ckeys, first, inverse = np.unique(batch.column("ckey").to_numpy(), return_index=True, return_inverse=True)
            if not len(ckeys):
                continue
            keys = batch.column("key").to_numpy()
            asks = np.bincount(inverse, weights=batch.column("asks").to_numpy(zero_copy_only=False), minlength=len(ckeys)) > 0
            order = np.lexsort((keys, inverse))
            starts = np.searchsorted(inverse[order], np.arange(len(ckeys)))
            ends = np.append(starts[1:], len(order))
            raw = batch.column("vec").take(pa.array(first))
            unit = _matrix(raw, dim)
            own = ix.cells(unit)
            visited: list[list[int]] = [[] for _ in ckeys]
            for r, cells in zip(np.flatnonzero(asks).tolist(), ix.visits(unit[asks], probe, most)):
                visited[r] = cells
            rows: dict[str, list] = {c: [] for c in ("block", "ckey", "cell", "keys", "cells", "which")}
            for r, c in enumerate(own.tolist()):
                ck = int(ckeys[r])
                places: dict[int, list[int]] = {}
                for v in visited[r]:
                    for block in ix.blocks_of(v):
                        places.setdefault(block, []).append(v)
                home = ix.blocks_of(c)[ck % len(ix.blocks_of(c))]
                places.setdefault(home, [])
                for block, cells in places.items():
                    at_home = block == home
                    rows["block"].append(block)
                    rows["ckey"].append(ck)
                    rows["cell"].append(c if at_home else -1)
                    rows["keys"].append(np.unique(keys[order[starts[r] : ends[r]]])[: k + 1].tobytes() if at_home else b"")
                    rows["cells"].append(np.array(cells, np.int32).tobytes())
                    rows["which"].append(r)
            kinds = {"block": pa.int32(), "ckey": pa.int64(), "cell": pa.int32(), "keys": pa.binary(), "cells": pa.binary()}
            cols = [pa.array(rows[c], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*cols, raw.take(pa.array(rows["which"]))], names=[*kinds, "vec"])

    return run


class _Members:
    """The classes that one block holds: vectors by cell, and the smallest keys of each class."""

    def __init__(self, rows: pa.Table, dim: int, k: int, least: float) -> None:
        ckey, order = np.unique(rows.column("ckey").to_numpy(), return_inverse=True)
        first = np.unique(order, return_index=True)[1]
        held: list[list[np.ndarray]] = [[] for _ in ckey]
        for at, raw in zip(order.tolist(), rows.column("keys").to_pylist()):
            held[at].append(np.frombuffer(raw, np.int64))
        self.held = [np.unique(np.concatenate(h))[: k + 1] if len(h) > 1 else h[0] for h in held]
        self.ckey, self.k, self.least = ckey, k, least
        cell = rows.column("cell").to_numpy()[first]
        self.vectors = _matrix(rows.column("vec"), dim)[first]
        self.visits = [np.zeros(0, np.int32)] * len(ckey)
        for at, raw in zip(order.tolist(), rows.column("cells").to_pylist()):
            if raw:  # a batch without a query of the class has sent none
                self.visits[at] = np.frombuffer(raw, np.int32)
        self.by_cell = np.argsort(cell, kind="stable").astype(np.int32)
        self.cells, self.start = np.unique(cell[self.by_cell], return_index=True)
        self.end = np.append(self.start[1:], len(ckey))
        self.low = np.append([h[0] for h in self.held], 0)  # the last entry stands for "none"
        self.single = np.append([len(h) == 1 for h in self.held], True)

    def search(self, ckey: np.ndarray, unit: np.ndarray, visits: list[np.ndarray], home: bool) -> pa.RecordBatch:
        """The best k classes of each visitor among the cells it visits, if there are any; memory is visitors * k."""
        k = self.k
        asker = np.repeat(np.arange(len(ckey)), [len(v) for v in visits])
        target = np.concatenate(visits) if visits else np.zeros(0, np.int32)
        by_target = np.argsort(target, kind="stable")
        asker, target = asker[by_target], target[by_target]
        best_s = np.full((len(ckey), k), -2, np.float32)
        best_m = np.full((len(ckey), k), -1, np.int32)
        for c, lo, hi in zip(self.cells, self.start, self.end):
            a, b = np.searchsorted(target, c, "left"), np.searchsorted(target, c, "right")
            m = self.by_cell[lo:hi]
            step = max(1, 2_000_000 // max(1, len(m)))
            for s in range(a, b, step):
                q = asker[s : min(b, s + step)]
                score = unit[q] @ self.vectors[m].T
                score[ckey[q][:, None] == self.ckey[m][None, :]] = -2
                names = np.broadcast_to(m, score.shape)
                if len(m) > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, names = np.take_along_axis(score, top, 1), m[top]
                both_s, both_m = np.concatenate([best_s[q], score], 1), np.concatenate([best_m[q], names], 1)
                top = np.argpartition(-both_s, k - 1, axis=1)[:, :k]
                best_s[q], best_m[q] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_m, top, 1)
        best_s = np.where(best_s >= self.least, best_s, -2)
        best_m = np.where(best_s > -2, best_m, -1)
        by_key = np.argsort(self.low[best_m], axis=1, kind="stable")
        best_s, best_m = np.take_along_axis(best_s, by_key, 1), np.take_along_axis(best_m, by_key, 1)
        by_score = np.argsort(-best_s, axis=1, kind="stable")
        best_s, best_m = np.take_along_axis(best_s, by_score, 1), np.take_along_axis(best_m, by_score, 1)
        plain, filled = self.single[best_m].all(axis=1), (best_s > -2).sum(axis=1)
        ids, scores, told = [], [], []
        for r in range(len(ckey)):
            if not filled[r] and not (home and len(visits[r]) and not self.single[r]):
                continue
            told.append(r)
            near, value = best_m[r, : filled[r]], best_s[r, : filled[r]]
            if plain[r]:
                ids.append(self.low[near].tobytes())
                scores.append(value.tobytes())
            else:  # classes with several keys: all of them, up to the k nearest
                names = [self.held[m] for m in near.tolist()]
                ids.append(np.concatenate(names)[: 2 * k].tobytes())
                scores.append(np.repeat(value, [len(x) for x in names])[: 2 * k].tobytes())
        mine = [self.held[r].tobytes() for r in told] if home else [b""] * len(told)
        return pa.RecordBatch.from_arrays([pa.array(ckey[told]), pa.array(mine, pa.binary()), pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], names=["ckey", "mine", "ids", "scores"])


def _search(dim: int, k: int, least: float):
    """Exact cosines between the visitors and the members of one block; members come first, visitors stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members = [], None
        for b in batches:
            at_home = int((b.column("cell").to_numpy() >= 0).sum())
            if at_home:
                held.append(b.slice(0, at_home))
            if at_home < b.num_rows:
                if members is None:
                    members = _Members(pa.Table.from_batches(held), dim, k, least) if held else False
                    held = []
                    if members:
                        yield members.search(members.ckey, members.vectors, members.visits, True)
                if members:
                    rest = b.slice(at_home)
                    yield members.search(rest.column("ckey").to_numpy(), _matrix(rest.column("vec"), dim), [np.frombuffer(c, np.int32) for c in rest.column("cells").to_pylist()], False)
        if members is None and held:
            members = _Members(pa.Table.from_batches(held), dim, k, least)
            yield members.search(members.ckey, members.vectors, members.visits, True)

    return run


def _merge(k: int):
    """Merges the lists of each class over its blocks; rows of a class arrive together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ckey, rows) -> tuple[list[int], list[float]]:
            mine = sorted({i for m, _, _ in rows for i in np.frombuffer(m, np.int64).tolist()})[: k + 1]
            near = {i: s for _, a, b in rows for i, s in zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.float32).tolist())}
            rest = sorted(((-s, i) for i, s in near.items() if i not in mine))[:k]
            return [*mine, *[i for _, i in rest]], [*[1.0] * len(mine), *[-s for s, _ in rest]]

        last, rows = None, []
        for b in batches:
            out: list = []
            for ckey, *row in zip(*[b.column(c).to_pylist() for c in ("ckey", "mine", "ids", "scores")]):
                if ckey != last:
                    if rows:
                        out.append((last, *close(last, rows)))
                    last, rows = ckey, []
                rows.append(row)
            yield _lists(out)
        if rows:
            yield _lists([(last, *close(last, rows))])

    return run


def _lists(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float32()))], names=["ckey", "ids", "scores"])


def nearest(
    vectors: DataFrame, key: str, embedding: str, k: int = 10, dim: int = 128, probe: int = PROBE, share: float = PROBE_SHARE, cells: int | None = None, least: float | None = None, queries: Column | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(key, neighbours: array of (id, cosine)), best first, of each query that has any.

    ``probe + share * n`` candidates are wanted, in at most ``cells`` cells; neighbours below
    ``least`` are left out. Runs a count, a bounded sample and the cell counts first.
    """
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = keep(vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<float>").alias("v"), asks.alias("asks")).where("key is not null").mapInArrow(_usable(dim), "key long, ckey long, asks boolean, vec binary"))
    typed = "array<struct<id:bigint,cosine:float>>"
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], f"key long, neighbours {typed}")
    wanted = probe + int(share * n)
    # without a bound on cells, they are large enough that a query visits about CELL_ROWS of them, however many candidates it wants
    count = int(np.clip(round((n / (NEAR_ROWS if cells else max(CELL_ROWS, wanted / CELL_ROWS))) ** 0.5), 1, MOST_CENTROIDS))
    part = min(1.0, min(SAMPLE, max(10_000, 64 * count)) / n)
    drawn = rows.where(F.pmod(F.xxhash64("ckey", "key"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("vec").toArrow()
    points = _matrix(drawn.column("vec"), dim) if drawn.num_rows else _matrix(rows.limit(1).select("vec").toArrow().column("vec"), dim)
    ix = Index(fit_centroids(points[:, : dim // 2], count), fit_centroids(points[:, dim // 2 :], count))
    sent = spark.sparkContext.broadcast(ix)
    counts = {r.cell: r["count"] for r in rows.mapInArrow(_with_cells(sent, dim), "cell int").groupBy("cell").count().collect()}
    ix.lay_out(counts, block_rows)
    laid = spark.sparkContext.broadcast(ix)
    routed = rows.mapInArrow(_route(laid, dim, k, wanted, cells), "block int, ckey long, cell int, keys binary, cells binary, vec binary")
    blocks = routed.repartitionById(ix.n_blocks, F.col("block")).sortWithinPartitions(F.col("cell") < 0)
    found = blocks.mapInArrow(_search(dim, k, -1.5 if least is None else least), "ckey long, mine binary, ids binary, scores binary")
    lists = found.repartition("ckey").sortWithinPartitions("ckey").mapInArrow(_merge(k), "ckey long, ids array<long>, scores array<float>")
    own = rows.where("asks").select("key", "ckey").dropDuplicates(["key"]).join(lists, "ckey")
    others = F.filter(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("cosine")), lambda x: x["id"] != F.col("key"))
    return own.select("key", F.slice(others, 1, k).cast(typed).alias("neighbours")).where(F.size("neighbours") > 0)


def near(vectors: DataFrame, key: str, embedding: str, least: float, k: int = 10, dim: int = 128, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``nearest`` of every vector for neighbours of a cosine of ``least`` or more, in NEAR_CELLS cells."""
    return nearest(vectors, key, embedding, k, dim, 1 << 40, 0.0, NEAR_CELLS, least, None, block_rows)


def mutual_pairs(lists: DataFrame, least: float = 0.9) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs in each other's lists with a cosine of at least ``least``."""
    one_way = lists.select("key", F.explode("neighbours").alias("x")).select("key", "x.id", "x.cosine").where(F.col("cosine") >= least)
    pairs = one_way.groupBy(F.least("key", "id").alias("id_a"), F.greatest("key", "id").alias("id_b")).agg(F.count("*").alias("ways"), F.max("cosine").alias("cosine"))
    return pairs.where("ways = 2").select("id_a", "id_b", "cosine")
