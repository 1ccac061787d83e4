"""Problem 2: references to records that do not exist, were removed, or arrive much later.

Method: the key space is cut into ranges. Each range holds its parents as one sorted
array; references stream past it in batches and are probed by binary search. Cut
points come from the references themselves, paired with a salt, so a key that a third
of all references name is spread over several ranges, and its parent row is copied
into each of them. References that hit in time vanish at the probe; only the misses
go on, to be listed or counted per table and month.

Edge cases: null, blank and repeated references count as none or once; keys are
compared without surrounding white space and in lower case; a null parent key or
null ``loaded_at`` is no parent, or one that is never late; an empty table of parents
makes every reference 'missing'; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import shuffle_partitions

SALTS = 1 << 16
SAMPLES_PER_CUT, LEAST_SAMPLE = 32, 4_096  # size of the key sample that sets the cut points; it never decides a result
KEY_BYTES = 64  # longer keys are ordered by their beginning and a digest, and compared in full
DAY_US = 86_400_000_000


def clean_key(c: Column) -> Column:
    """Without white space around it, in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def parents(rows: DataFrame, key: str, removals: DataFrame, tab: str, space: str) -> DataFrame:
    """(space, key, first_us, gone): every known key with its first arrival, and whether a standing removal names it."""
    there = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("first_us"), F.lit(True).alias("there"), F.lit(False).alias("gone"))
    removed = removals.where((F.col("tab") == tab) & F.col("restored_at").isNull()).select(F.col("object_id").cast("string").alias("key"), F.lit(None).cast("long").alias("first_us"), F.lit(False).alias("there"), F.lit(True).alias("gone"))
    return (
        there.unionByName(removed)
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("first_us").alias("first_us"), F.max("there").alias("there"), F.max("gone").alias("gone"))
        .select(F.lit(space).alias("space"), "key", "first_us", "there", "gone")
    )


def references(rows: DataFrame, key: str, fields: list[str], tab: str, space: str) -> DataFrame:
    """(tab, ref_key, field_name, target_key, space, ref_us, made): each different reference once."""
    arrays = dict(rows.dtypes)
    named = F.array(*[F.struct(F.lit(f).alias("field_name"), (F.col(f) if arrays[f].startswith("array") else F.array(f)).alias("targets")) for f in fields])
    each = (
        rows.where(F.col(key).isNotNull())
        .select(F.col(key).cast("string").alias("ref_key"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("ref_us"), F.col("created_at").alias("made"), F.explode(named).alias("f"))
        .select("ref_key", "ref_us", "made", "f.field_name", F.explode("f.targets").alias("raw"))
        .select("ref_key", "field_name", clean_key(F.col("raw")).alias("target_key"), "ref_us", "made")
        .where(F.col("target_key").isNotNull())
    )
    return (
        each.groupBy("ref_key", "field_name", "target_key")
        .agg(F.min("ref_us").alias("ref_us"), F.min("made").alias("made"))
        .select(F.lit(tab).alias("tab"), "ref_key", "field_name", "target_key", F.lit(space).alias("space"), "ref_us", "made")
    )


def _cut_points(refs: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Cut points (space and key, salt) from a uniform sample of references: the least hash of each of a fixed number of buckets.

    What reaches the driver is that number of rows, however many references or tasks there are.
    """
    drawn = refs.select(F.xxhash64("ref_key", "field_name", "target_key").alias("h"), F.concat_ws("\x1f", "space", "target_key").alias("k"), F.pmod(F.xxhash64("ref_key", "field_name"), F.lit(SALTS)).cast("int").alias("salt"))
    buckets = max(LEAST_SAMPLE, SAMPLES_PER_CUT * ranges)
    least = drawn.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", "k", "salt")).alias("m")).select("m.k", "m.salt")
    got = sorted((_fixed(r.k.encode()), r.salt) for r in least.collect())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _fixed(key: bytes) -> bytes:
    """The key itself up to KEY_BYTES bytes; of a longer one, or one that ends in a zero byte, its beginning and a digest."""
    import xxhash

    return key if len(key) <= KEY_BYTES and key[-1:] != b"\0" else key[: KEY_BYTES - 32].ljust(KEY_BYTES - 32, b"\1") + xxhash.xxh3_128_hexdigest(key).encode()


def _keys(batch: pa.RecordBatch | pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Space and key of each row in full, and as a fixed-width array that sorts and compares vectorised."""
    full = [f"{s}\x1f{k}".encode() for s, k in zip(batch.column("space").to_pylist(), batch.column("key").to_pylist())]
    return full, np.array([_fixed(k) for k in full], f"S{KEY_BYTES}")


def _range_of(cuts: list[tuple[bytes, int]]):
    keys = np.array([k for k, _ in cuts], f"S{KEY_BYTES}")
    salts = np.array([s for _, s in cuts], np.int64)

    def at(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for first in np.unique(lo[hi > lo]):  # keys that are cut points themselves: their salts decide
            mine = np.flatnonzero((lo == first) & (hi > lo))
            lo[mine] += np.searchsorted(salts[first : hi[mine[0]]], salt[mine], "right")
        return lo.astype(np.int32)

    return at


def _place(cuts: list[tuple[bytes, int]], parent: bool):
    """Adds the range of each reference, or every range that a parent's key spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _range_of(cuts)
        for b in batches:
            _, keys = _keys(b)
            if parent:
                first, last = at(keys, np.full(len(keys), -1)), at(keys, np.full(len(keys), SALTS))
                each = last - first + 1
                part = np.repeat(last - np.cumsum(each) + 1, each) + np.arange(each.sum())
                b = b.take(pa.array(np.repeat(np.arange(len(keys)), each)))
            else:
                part = at(keys, b.column("salt").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32), pa.int32())], names=[*b.schema.names, "part"])

    return run


def _probe(late_us: int):
    """Streams one partition, sorted by range with parents first; passes on what misses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, table = None, None
        for b in batches:
            part, is_ref = b.column("part").to_numpy(zero_copy_only=False), b.column("is_ref").to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.diff(part * 2 + is_ref)) + 1
            for lo, hi in zip([0, *runs], [*runs, len(part)]):
                if hi == lo:
                    continue
                piece = b.slice(lo, hi - lo)
                if part[lo] != current:
                    current, held, table = part[lo], [], None
                if not is_ref[lo]:
                    held.append(piece)
                    continue
                if table is None:
                    t = pa.Table.from_batches(held) if held else None
                    full, names = _keys(t) if held else ([], np.zeros(0, f"S{KEY_BYTES}"))
                    order = np.argsort(names, kind="stable")
                    keys, whole = names[order], [full[k] for k in order.tolist()]
                    first = t.column("us").to_pandas().to_numpy(float)[order] if held else np.zeros(0)
                    there, gone = (t.column(c).to_numpy().astype(bool)[order] if held else np.zeros(0, bool) for c in ("there", "gone"))
                    table, held = (keys, whole, first, there, gone), []
                keys, whole, first, there, gone = table
                asked, wanted = _keys(piece)
                pos = np.searchsorted(keys, wanted, "left")
                hit = np.zeros(len(wanted), bool)
                inside = pos < len(keys)
                hit[inside] = keys[pos[inside]] == wanted[inside]
                for k in np.flatnonzero(hit & (np.char.str_len(wanted) >= KEY_BYTES)).tolist():
                    hit[k] = whole[pos[k]] == asked[k]
                safe = np.where(hit, pos, 0)
                us = piece.column("us").to_pandas().to_numpy(float)
                if len(keys):
                    gone_, there_, late_ = hit & gone[safe], hit & there[safe], hit & (first[safe] - us > late_us)
                else:
                    gone_ = there_ = late_ = hit
                kind = np.where(gone_, "deleted", np.where(~there_, "missing", np.where(late_, "late", "")))
                rows = pa.array(np.flatnonzero(kind != ""))
                out = piece.take(rows)
                yield pa.RecordBatch.from_arrays(
                    [out.column("tab"), out.column("ref_key"), out.column("field_name"), out.column("key"), pa.array(kind[kind != ""].astype(object), pa.string()), out.column("made")],
                    names=["tab", "ref_key", "field_name", "target_key", "kind", "made"],
                )

    return run


def orphans(refs: DataFrame, known: DataFrame, late_days: float = 7, ranges: int | None = None) -> DataFrame:
    """(tab, ref_key, field_name, target_key, kind, ref_month): references that lead nowhere, to a removed or to a late record.

    ``refs`` and ``known`` are as made by ``references`` and ``parents``.
    """
    spark = refs.sparkSession
    parts = ranges or shuffle_partitions(spark)
    cuts = _cut_points(refs, parts)
    typed = "space string, key string, us long, there boolean, gone boolean, tab string, ref_key string, field_name string, made timestamp, salt int, is_ref boolean"
    none = {"tab": "string", "ref_key": "string", "field_name": "string", "made": "timestamp", "salt": "int"}
    left = known.select("space", "key", F.col("first_us").alias("us"), "there", "gone", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(False).alias("is_ref"))
    right = refs.select("space", F.col("target_key").alias("key"), F.col("ref_us").alias("us"), F.lit(False).alias("there"), F.lit(False).alias("gone"), "tab", "ref_key", "field_name", F.col("made").cast("timestamp").alias("made"), F.pmod(F.xxhash64("ref_key", "field_name"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(True).alias("is_ref"))
    placed = left.mapInArrow(_place(cuts, True), typed + ", part int").unionByName(right.mapInArrow(_place(cuts, False), typed + ", part int"))
    met = placed.drop("salt").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "is_ref")
    missed = met.mapInArrow(_probe(round(late_days * DAY_US)), "tab string, ref_key string, field_name string, target_key string, kind string, made timestamp")
    return missed.select("tab", "ref_key", "field_name", "target_key", "kind", F.date_format("made", "yyyy-MM").alias("ref_month"))


def orphan_report(found: DataFrame) -> DataFrame:
    """(tab, field_name, kind, ref_month, n_refs): misses per table, field, kind and month."""
    return found.groupBy("tab", "field_name", "kind", "ref_month").agg(F.count("*").alias("n_refs"))
