"""Problem 8: texts packed into containers of fixed capacity, none split unless it alone exceeds it.

Method: best-fit decreasing with a segment tree over remaining capacities. Sizes are
whole numbers up to the capacity, so open bins with equal room are interchangeable: the
tree counts open bins per remaining capacity and finds the tightest that fits an item in
logarithmic time. All items of one size are placed together, as runs of bins. The state
depends on the capacity only, not on the number of items, so the plan for the whole
corpus is made from the histogram of sizes (at most ``capacity`` + 1 rows), and is the
plan that best-fit decreasing makes item by item.

Items get their place by rank among equal sizes. Ranks are counted per bucket of keys
and shifted by the buckets before, so a size that a third of all items share is ranked
in many tasks.

Edge cases: null, empty and token-less texts have size 0 and need no bin (``bin_id`` is
null); an item above the capacity is cut into full pieces and a rest; a repeated key
counts once; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import materialize, shuffle_partitions, tokenizer_path

CAPACITY = 2048


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, n_tokens) by a public byte-level tokenizer; 0 for null and empty texts. The rank file is read once and broadcast."""
    spark = documents.sparkSession
    with open(tokenizer_path(spark, vocabulary), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    return documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, n_tokens long")


class RoomTree:
    """Counts of open bins by remaining capacity; the least capacity of at least s with an open bin, in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity).bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        node = room + self.leaves
        while node:
            self.sums[node] += bins
            node >>= 1

    def tightest(self, size: int) -> int | None:
        node = size + self.leaves
        if self.sums[node]:
            return size
        while node > 1:
            if not node & 1 and self.sums[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.sums[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, first bin, items per bin) and the number of bins, for best-fit decreasing."""
    tree = RoomTree(capacity)
    open_bins: dict[int, deque[tuple[int, int]]] = {}
    runs, bins = [], 0

    def give_back(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            queue = open_bins.setdefault(room, deque())
            if queue and queue[-1][1] == lo:
                queue[-1] = (queue[-1][0], hi)
            else:
                queue.append((lo, hi))
            tree.add(room, hi - lo)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, lo = capacity, bins
                each = capacity // size
                hi = lo + -(-left // each)
                bins = hi
            else:
                each = room // size
                lo, hi = open_bins[room][0]
                take = min(hi - lo, -(-left // each))
                open_bins[room].popleft()
                if lo + take < hi:
                    open_bins[room].appendleft((lo + take, hi))
                hi = lo + take
                tree.add(room, lo - hi)
            placed = min(left, each * (hi - lo))
            runs.append((size, rank, lo, each))
            full = placed // each
            give_back(room - each * size, lo, lo + full)
            if placed % each:
                give_back(room - (placed % each) * size, lo + full, lo + full + 1)
            left, rank = left - placed, rank + placed
    return runs, bins


def _to_bins(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, first, each = (np.array(x, np.int64) for x in runs.value)
        start = (size << 40) + rank
        order = np.argsort(start)
        for b in batches:
            wanted = (b.column("n_tokens").to_numpy().astype(np.int64) << 40) + b.column("rank").to_numpy()
            at = order[np.searchsorted(start, wanted, "right", sorter=order) - 1]
            bins = first[at] + (b.column("rank").to_numpy() - rank[at]) // each[at]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("piece"), b.column("n_tokens"), pa.array(bins, pa.int64())], names=["key", "piece", "n_tokens", "bin_id"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n_tokens, bin_id) of (key, n_tokens). Writes the sizes and runs their histogram first."""
    spark = sizes.sparkSession
    once = materialize(sizes.dropDuplicates(["key"]), "sizes")
    whole = F.col("n_tokens") <= capacity
    full = (F.col("n_tokens") / F.lit(capacity)).cast("long")
    parts = F.when(whole, F.array("n_tokens")).otherwise(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when(F.col("n_tokens") % capacity > 0, F.array(F.col("n_tokens") % capacity)).otherwise(F.array().cast("array<bigint>"))))
    items = once.select("key", F.posexplode(parts).alias("piece", "n_tokens"))
    counts = {r.n_tokens: r["count"] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    runs, _ = plan(counts, capacity)
    held = spark.sparkContext.broadcast(tuple(zip(*runs)) if runs else ((), (), (), ()))
    buckets = 4 * shuffle_partitions(spark)
    placed = items.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = placed.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = per_bucket.select("n_tokens", "bucket", before.alias("shift"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("key", "piece")) - 1
    ranked = placed.withColumn("local", local).join(shifts, ["n_tokens", "bucket"]).select("key", "piece", "n_tokens", (F.col("local") + F.col("shift")).cast("long").alias("rank"))
    binned = ranked.mapInArrow(_to_bins(held), "key long, piece int, n_tokens long, bin_id long")
    return binned.unionByName(items.where("n_tokens = 0").withColumn("bin_id", F.lit(None).cast("long")))


def bins(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, n_items, used, free) of each container."""
    return packed.where("bin_id is not null").groupBy("bin_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
