"""Problem 1: records that say the same with small edits, insertions or another order.

Exact set-similarity self-join on distinct words, Jaccard >= ``num/den``.

Method: universe-partition pigeonhole. Word hashes split the universe into ``m``
segments; ``m`` is set by the size band of the indexed record. A record is indexed
under each segment's subset of its words and under every one-deletion neighbour of
that subset. A probing record spends levels on its segments: level 1 looks up the
equal subset, level 2 also subsets one word away. Two sets whose symmetric
difference is at most H differ, in some segment, by less than the level spent there
whenever the levels add up to H + 1, so no pair can be missed. Which segments get
the levels is chosen per record by a small dynamic program over estimated posting
lengths (a count sketch of fixed size over all signatures of the corpus).

Survivors pass a parity filter (64 parity bits of the word set: each differing word
flips one bit, so more than H differing bits prove a non-pair), and are then
verified on the words themselves.

Records with equal word sets form one class and are joined once; classes up to
``expand`` members come out as all their pairs, larger ones as a star around their
smallest id, so that no group of copies is squared. A class is known by a 64-bit hash of
its words; a second, independent one is carried along, and a query whose data hold two word
sets that agree in the first and not in the second stops instead of mixing them up.

Groups are the connected components of the links between classes, so a record belongs to
one group however many records it is similar to.

Edge cases: null content or quote counts as empty; records with fewer than
``min_words`` distinct words take no part; a repeated id counts once; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import components
from memloom.session import keep, materialize, shuffle_partitions

WORD = re.compile(r"[^\W_]+")
RATIO = 3  # a size band holds sizes s with low <= s < 3 * low
SKETCH_BITS = 20
SIGS_PER_TASK = 3_000_000
BLOCK = 2_000_000
FILTER_BITS = 23

# what an index or probe entry is for
DEL, ASK_FULL, ASK_DEL, INDEXED = 1, 2, 4, 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Scheme:
    """Bands, segment counts and distance bounds of one threshold."""

    def __init__(self, num: int, den: int, min_words: int) -> None:
        self.num, self.den, self.low = num, den, max(1, min_words)

    def distance(self, r, s):
        """Largest symmetric difference that sets of these sizes may have."""
        both = np.asarray(r, np.int64) + np.asarray(s, np.int64)
        return both - 2 * -(-self.num * both // (self.num + self.den))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        out, low = np.zeros(len(sizes), np.int64), self.low * RATIO
        while len(sizes) and low <= sizes.max():
            out += sizes >= low
            low *= RATIO
        return out

    def bounds(self, band: int) -> tuple[int, int]:
        low = self.low * RATIO**band
        return low, low * RATIO - 1

    def segments(self, band: int) -> int:
        top = self.bounds(band)[1]
        return (int(self.distance(top, top)) + 2) // 2 + 1


def _hashes(lines: list[str], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all lines, flat, and the number of words of each line."""
    import xxhash

    flat, sizes = [], []
    for line in lines:
        words = line.split(" ")
        sizes.append(len(words))
        for w in words:
            h = seen.get(w)
            if h is None:
                if len(seen) > 500_000:  # only a cache of a pure function
                    seen.clear()
                h = seen[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
    return np.array(flat, np.uint64), np.array(sizes, np.int64)


def _signatures(words: np.ndarray, sizes: np.ndarray, band: int, m: int):
    """Subset signatures (rows x m), subset sizes, one-deletion signatures (per word) and each word's segment."""
    rows = len(sizes)
    row = np.repeat(np.arange(rows), sizes)
    seg = row * m + (words % np.uint64(m)).astype(np.int64)
    mixed = _mix(words)
    order = np.argsort(seg, kind="stable")
    full = np.zeros(rows * m, np.uint64)
    if len(order):
        ends, starts = np.unique(seg[order], return_index=True)
        with np.errstate(over="ignore"):
            full[ends] = np.add.reduceat(mixed[order], starts)
    salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
    with np.errstate(over="ignore"):
        less = _mix(full[seg] - mixed + salt[seg % m])
        full = _mix(full + np.tile(salt, rows))
    return full.reshape(rows, m), np.bincount(seg, minlength=rows * m).reshape(rows, m), less, seg


def _bucket(sigs: np.ndarray) -> np.ndarray:
    return ((sigs >> np.uint64(8)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _allocate(full: np.ndarray, held: np.ndarray, less: np.ndarray, seg: np.ndarray, need: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Levels (rows x m) that add up to ``need`` at the least estimated number of postings."""
    rows, m = full.shape
    one = counts[_bucket(full)] + 1.0
    two = one + np.bincount(seg, weights=counts[_bucket(less)] + 1.0, minlength=rows * m).reshape(rows, m)
    top = int(need.max())
    best = np.full((rows, top + 1), np.inf)
    best[:, 0] = 0
    picked = np.zeros((m, rows, top + 1), np.uint8)
    back1 = np.maximum(np.arange(top + 1) - 1, 0)
    back2 = np.maximum(np.arange(top + 1) - 2, 0)
    for k in range(m):
        a, b = best[:, back1] + one[:, k : k + 1], best[:, back2] + two[:, k : k + 1]
        picked[k] = np.where(a < best, 1, 0)
        best = np.minimum(best, a)
        picked[k] = np.where(b < best, 2, picked[k])
        best = np.minimum(best, b)
    levels, at, all_rows = np.zeros((rows, m), np.uint8), need.copy(), np.arange(rows)
    for k in range(m - 1, -1, -1):
        levels[:, k] = picked[k, all_rows, at]
        at = np.maximum(at - levels[:, k], 0)
    return levels


def _word_lines(min_words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, checks, sizes, lines = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                if len(words) < min_words or key is None:
                    continue
                line = " ".join(sorted(words))
                ids.append(key)
                keys.append(xxhash.xxh64_intdigest(line) - (1 << 63))
                checks.append(xxhash.xxh64_intdigest(line, 1) - (1 << 63))
                sizes.append(len(words))
                lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lines, pa.string())],
                names=["id", "skey", "check", "n", "words"],
            )

    return run


def _fresh(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The batch without word sets that this task has had; bounded memory, later stages drop the rest."""
    keep_rows = []
    for k, key in enumerate(batch.column("skey").to_pylist()):
        if key not in seen:
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(key)
            keep_rows.append(k)
    return batch.take(pa.array(keep_rows, pa.int64()))


def _by_band(batch: pa.RecordBatch, scheme: Scheme, cache: dict[str, int]):
    """For each band that records of the batch are indexed in or probe: rows, hashes, need, and whether they are indexed."""
    n = batch.column("n").to_numpy().astype(np.int64)
    words, sizes = _hashes(batch.column("words").to_pylist(), cache)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = scheme.band(n)
    for band in range(int(own.max()) + 2 if len(n) else 0):
        low = scheme.bounds(band)[0]
        # a record asks its own band for partners up to its size, and the next band for larger ones
        above = (own == band - 1) & (n * scheme.den >= low * scheme.num)
        for rows, indexed in ((np.flatnonzero(own == band), True), (np.flatnonzero(above), False)):
            if len(rows):
                flat = np.concatenate([words[starts[r] : starts[r + 1]] for r in rows])
                largest = n[rows] if indexed else n[rows] * scheme.den // scheme.num
                yield band, indexed, rows, flat, n[rows], scheme.distance(n[rows], largest) + 1


def _sketch(scheme: Scheme):
    """Counts of all signatures, hashed into a vector of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cache, seen, total = np.zeros(1 << SKETCH_BITS, np.int64), {}, set(), 0
        for batch in batches:
            batch = _fresh(batch, seen)
            for band, indexed, _, flat, sizes, _ in _by_band(batch, scheme, cache):
                if indexed:
                    full, _, less, _ = _signatures(flat, sizes, band, scheme.segments(band))
                    for sigs in (full.ravel(), less):
                        counts += np.bincount(_bucket(sigs), minlength=len(counts))
                        total += len(sigs)
        if total:
            parts = np.minimum(counts, 65535).astype(np.uint16).reshape(64, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(64), pa.int32()), pa.array([total] + [0] * 63, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["part", "total", "counts"],
            )

    return run


def _add_up(key, table):
    vectors = [np.frombuffer(x, np.uint16 if len(x) == (1 << SKETCH_BITS) // 32 else np.uint32).astype(np.uint32) for x in table.column("counts").to_pylist()]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([sum(table.column("total").to_pylist())], pa.int64()), "counts": pa.array([np.sum(vectors, axis=0, dtype=np.uint32).tobytes()], pa.binary())})


def _entries(scheme: Scheme, parts: int, sketch):
    """One row per record and partition with all its packed entries there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cache, seen = np.frombuffer(sketch.value, np.uint32).astype(np.float64), {}, set()
        for whole in batches:
            whole = _fresh(whole, seen)
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                keys, sizes = batch.column("skey").to_numpy(), batch.column("n").to_numpy()
                for band, indexed, rows, flat, n, need in _by_band(batch, scheme, cache):
                    m = scheme.segments(band)
                    full, held, less, seg = _signatures(flat, n, band, m)
                    levels = _allocate(full, held, less, seg, need, counts)
                    of_row = np.repeat(np.arange(len(rows)), n)
                    parity = np.bitwise_xor.reduceat(np.uint64(1) << (flat >> np.uint64(58)), np.concatenate([[0], np.cumsum(n)[:-1]]))
                    flags_full = np.where(levels >= 1, ASK_FULL, 0) | np.where(levels == 2, ASK_DEL, 0) | (INDEXED if indexed else 0)
                    flags_less = np.where(levels.ravel()[seg] == 2, ASK_FULL, 0) | (INDEXED if indexed else 0) | DEL
                    sigs = np.concatenate([full.ravel(), less])
                    flags = np.concatenate([flags_full.ravel(), flags_less]).astype(np.uint32)
                    of = np.concatenate([np.repeat(np.arange(len(rows)), m), of_row])
                    live = (flags & ~np.uint32(DEL)) > 0
                    sigs, flags, of = sigs[live], flags[live], of[live]
                    entry = ((sigs >> np.uint64(36)).astype(np.uint32) << np.uint32(4)) | flags
                    slot = of * parts + (sigs % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(slot, kind="stable")
                    at, starts = np.unique(slot[order], return_index=True)
                    packed = entry[order]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((at % parts).astype(np.int32)),
                            pa.array(keys[rows][at // parts]),
                            pa.array(sizes[rows][at // parts].astype(np.int32)),
                            pa.array(parity[at // parts].view(np.int64)),
                            pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(starts * 4, len(packed) * 4).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())]),
                        ],
                        names=["part", "skey", "n", "parity", "entries"],
                    )

    return run


def _matches(scheme: Scheme):
    """Joins the entries of one partition; pairs that the parity filter cannot refute."""

    def within(keys, n, parity, entries, lengths) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rec, widest = np.repeat(np.arange(len(keys)), lengths), int(scheme.distance(n.max(), n.max()))
        sig, flag = entries >> np.uint32(4), entries & np.uint32(15)
        indexed, is_del = (flag & INDEXED) > 0, (flag & DEL) > 0
        for asks, stored in (((flag & ASK_FULL) > 0, indexed & ~is_del), ((flag & ASK_DEL) > 0, indexed & is_del)):
            order = np.flatnonzero(stored)
            order = order[np.argsort(sig[order])]
            table, owner = sig[order], rec[order]
            probe = np.flatnonzero(asks)
            lo = np.searchsorted(table, sig[probe], "left")
            hits = np.searchsorted(table, sig[probe], "right") - lo
            live = hits > 0
            probe, lo, hits = probe[live], lo[live], hits[live]
            ends = np.cumsum(hits)
            done, last = 0, int(ends[-1]) if len(ends) else 0
            while done < last:  # blocks of hits, cutting through long lists where need be
                upto = min(last, done + BLOCK)
                a, b = np.searchsorted(ends, done, "right"), np.searchsorted(ends, upto, "left") + 1
                size = np.minimum(ends[a:b], upto) - np.maximum(ends[a:b] - hits[a:b], done)
                skip = np.maximum(done - (ends[a:b] - hits[a:b]), 0)
                start = np.repeat(lo[a:b] + skip - (np.cumsum(size) - size), size)
                x, y = np.repeat(rec[probe[a:b]], size), owner[start + np.arange(upto - done)]
                done = upto
                ok = np.bitwise_count(parity[x] ^ parity[y]) <= widest
                x, y = x[ok], y[ok]
                nx, ny = n[x], n[y]
                # within a band the larger set asks; the next band is asked by the smaller
                ok = (ny < nx) | ((ny == nx) & (keys[y] < keys[x])) | (scheme.band(ny) > scheme.band(nx)) if len(nx) else np.zeros(0, bool)
                ok &= np.minimum(nx, ny) * scheme.den >= np.maximum(nx, ny) * scheme.num
                x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
                ok = np.bitwise_count(parity[x] ^ parity[y]) <= scheme.distance(nx, ny)
                x, y = x[ok], y[ok]
                if len(x):
                    both = np.unique(np.stack([np.minimum(keys[x], keys[y]), np.maximum(keys[x], keys[y])], 1), axis=0)
                    yield both[:, 0], both[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        # copies of a word set from other tasks: one stays per set and kind of row
        part, keys, n = t.column("part").to_numpy(), t.column("skey").to_numpy(), t.column("n").to_numpy().astype(np.int64)
        parity = t.column("parity").to_numpy().view(np.uint64)
        rows = t.column("entries").to_pylist()
        kind = np.array([bool(r[0] & INDEXED) for r in rows])
        _, one = np.unique(np.stack([part, keys, kind], 1), axis=0, return_index=True)
        lengths = np.array([len(rows[k]) // 4 for k in one])
        entries = np.frombuffer(b"".join([rows[k] for k in one]), np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        part = part[one]
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            of = one[mine]
            for a, b in within(keys[of], n[of], parity[of], entries[ends[mine[0]] : ends[mine[-1] + 1]], lengths[mine]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["ka", "kb"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of fixed size with two bits for each key, in parts."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        bits[_spots(b.column(0).to_numpy())] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64), pa.int32()), pa.array([np.packbits(x).tobytes() for x in bits.reshape(64, -1)], pa.binary())], names=["part", "bits"])


def _spots(keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    return np.stack([(k >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1) for s in (3, 37)]).astype(np.int64)


def _either(key, table):
    both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})


def _only_marked(bits, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(held[_spots(b.column(column).to_numpy())].all(axis=0)))

    return run


def reduced_to(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``table`` without most rows whose ``column`` isn't among ``keys``, before any shuffle of it.

    A runtime filter of 2^FILTER_BITS bits, whatever the input: rows that pass are still
    joined, so only the volume depends on it. Runs ``keys``.
    """
    parts = keys.mapInArrow(_marks, "part int, bits binary").groupBy("part").applyInArrow(_either, "part int, bits binary").collect()
    bits = b"".join(bytes(r.bits) for r in sorted(parts, key=lambda r: r.part)) or bytes((1 << FILTER_BITS) // 8)
    return table.mapInArrow(_only_marked(table.sparkSession.sparkContext.broadcast(bits), column), table.schema)


def word_sets(records: DataFrame, key: str, texts: list[str], min_words: int) -> DataFrame:
    """(id, skey, check, n, words): the distinct words of each record, sorted, and two hashes of that set, the first of which is the class key."""
    text: Column = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
    return records.select(F.col(key).cast("string"), text).mapInArrow(_word_lines(min_words), "id string, skey long, check long, n int, words string")


def class_links(sets: DataFrame, num: int, den: int, min_words: int) -> DataFrame:
    """(ka, kb): pairs of different word sets with Jaccard >= num/den, each once. Runs the count sketch (64 rows) first."""
    spark, scheme = sets.sparkSession, Scheme(num, den, min_words)
    parts_of = sets.select("skey", "n", "words")
    summed = parts_of.mapInArrow(_sketch(scheme), "part int, total long, counts binary").groupBy("part").applyInArrow(_add_up, "part int, total long, counts binary").collect()
    if not summed:
        return spark.createDataFrame([], "ka long, kb long")
    counts = b"".join(r.counts for r in sorted(summed, key=lambda r: r.part))
    tasks = max(shuffle_partitions(spark), -(-sum(r.total for r in summed) // SIGS_PER_TASK))
    entries = parts_of.mapInArrow(_entries(scheme, tasks, spark.sparkContext.broadcast(counts)), "part int, skey long, n int, parity long, entries binary")
    found = keep(entries.repartitionById(tasks, F.col("part")).mapInArrow(_matches(scheme), "ka long, kb long").distinct())
    named = found.select(F.explode(F.array("ka", "kb")).alias("skey"))
    words = keep(reduced_to(sets.select("skey", "words"), "skey", named).dropDuplicates(["skey"]))
    both = found.join(words.withColumnsRenamed({"skey": "ka", "words": "wa"}), "ka").join(words.withColumnsRenamed({"skey": "kb", "words": "wb"}), "kb")
    a, b = F.split("wa", " "), F.split("wb", " ")
    shared = F.size(F.array_intersect(a, b))
    return both.where(den * shared >= num * (F.size(a) + F.size(b) - shared)).select("ka", "kb")


def _one_set() -> Column:
    """Of a class, true; an error if two word sets share its key."""
    return F.when(F.min("check") == F.max("check"), F.lit(True)).otherwise(F.raise_error(F.lit("two word sets share a 64-bit key")).cast("boolean"))


def near_duplicate_pairs(records: DataFrame, key: str, texts: list[str], num: int = 7, den: int = 10, min_words: int = 24, expand: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all similar pairs, copies of more than ``expand`` members as stars."""
    sets = keep(word_sets(records, key, texts, min_words))
    members = sets.select("skey", "id")
    # repeated deliveries count here too: that only sends their class through the distinct below
    sized = keep(sets.groupBy("skey").agg(F.count("*").alias("copies"), F.min("id").alias("first"), _one_set().alias("sound")).where("sound").drop("sound"))
    many = keep(sized.where("copies > 1"))
    links = keep(class_links(sets, num, den, min_words))
    linked = reduced_to(members, "skey", links.select(F.explode(F.array("ka", "kb")).alias("skey")))
    shown = linked.join(sized, "skey").where((F.col("copies") <= expand) | (F.col("id") == F.col("first"))).select("skey", "id")
    across = links.join(shown.withColumnsRenamed({"skey": "ka", "id": "x"}), "ka").join(shown.withColumnsRenamed({"skey": "kb", "id": "y"}), "kb").select("x", "y")
    copies = reduced_to(members, "skey", many.select("skey")).join(many, "skey")
    small = copies.where(F.col("copies") <= expand).select("skey", F.col("id").alias("x"))
    inside = small.join(small.withColumnRenamed("x", "y"), "skey").where("x < y").select("x", "y")
    star = copies.where((F.col("copies") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    return across.unionByName(inside).unionByName(star).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_classes(records: DataFrame, key: str, texts: list[str], num: int = 7, den: int = 10, min_words: int = 24) -> DataFrame:
    """(id, class_id, copies, links, group_id): each record with its class of equal word sets (by smallest id), the number of other classes
    that it is similar to, and its group of classes connected by similarity (by smallest id)."""
    sets = keep(word_sets(records, key, texts, min_words))
    members = keep(sets.select("skey", "check", "id").distinct())
    sized = members.groupBy("skey").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"), _one_set().alias("sound")).where("sound").drop("sound")
    links = materialize(class_links(sets, num, den, min_words), "links")
    degree = links.select(F.explode(F.array("ka", "kb")).alias("skey")).groupBy("skey").agg(F.count("*").alias("links"))
    of_class = materialize(sized.join(degree, "skey", "left").join(components(links, "ka", "kb").withColumnRenamed("node", "skey"), "skey", "left").withColumn("component", F.coalesce("component", "skey")), "classes")
    groups = of_class.groupBy("component").agg(F.min("class_id").alias("group_id"))
    named = of_class.join(groups, "component").select("skey", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
    return members.select("skey", "id").join(named, "skey").select("id", "class_id", "copies", "links", "group_id")
