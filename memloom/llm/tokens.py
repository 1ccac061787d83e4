"""Problem 7: the whole corpus encoded by a public byte-level BPE tokenizer, and decoded again.

Method: Spark higher-order functions. Texts are cut into words by the tokenizer's own
pattern; a word becomes a byte array, and an ``aggregate`` folds the ranked merges over
it, looking ranks up in a rank map that enters the plan as one literal (parsed from JSON
when the plan is optimised: an array of small hash buckets, so a lookup is a hash, an
index and a map of one or two entries). Bytes are held as strings of one character per
byte (ISO-8859-1), which Spark slices and concatenates. Decoding concatenates the binary
pieces of the ids.

Distinct words are folded, not occurrences. A first pass counts every word of the corpus;
the HOT_WORDS most frequent ones are folded once and enter the second pass as a literal
map of bounded size. Every other word is folded where it stands, once per document that
has it: such words hardly recur, so this is about as much work as folding the corpus's
distinct rest, and no text, word or id is shuffled. The bound moves work, never a result.

The fold takes quadratic time in the bytes of a word. Words of more than FOLD_BYTES bytes
(an unbroken run of a thousand letters) are merged by a heap in an Arrow function before
the second pass, with the same ranks and result; the test data have none.

Edge cases: null and empty texts give an empty list of ids; text is encoded as it is,
strings that look like special tokens included; every document row comes out once;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import keep, shuffle_partitions, tokenizer_path

# fixed value: the pattern that splits text before the merges, in Java's syntax
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 1 << 15
HOT_WORDS = 65_536  # bound of the literal map of frequent words
FOLD_BYTES = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of the bytes, a blank, the rank, per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def byte_string(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters 0 to 255."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _look_up(table: Column) -> Callable[[Column], Column]:
    """Of a text, its value in a table of hash buckets, null if it has none.

    ``table`` should be a bound variable: a literal of this size is to stand in the plan once.
    """

    def value(piece: Column) -> Column:
        return F.try_element_at(F.element_at(table, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int") + 1), piece)

    return value


class Ranks:
    """The rank map, and the pieces by id, as literals of the plan."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        slots: list[dict[str, int] | None] = [None] * BUCKETS
        for piece, rank in self.ranks.items():
            name = piece.decode("latin-1")
            at = zlib.crc32(name.encode()) % BUCKETS
            slots[at] = {**(slots[at] or {}), name: rank}
        self.table = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")

    @property
    def pieces(self) -> Column:
        """The pieces by id, in hex."""
        by_id = [""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            by_id[rank] = piece.hex()
        return F.from_json(F.lit(json.dumps(by_id)), "array<string>")



def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once: a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(word: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of the bytes of one word: ranked merges folded over its byte array. A word of the vocabulary is its own id."""
    size = F.length(word)
    start = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))

    def merge(parts: Column, step: Column) -> Column:
        seen = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(parts[i - 1], parts[i]))))

        def join(found: Column) -> Column:
            at = F.array_position(found["r"], found["least"]).cast("int")
            return F.when(
                found["least"].isNotNull(),
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(parts[at - 1], parts[at])), F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0)))),
            ).otherwise(parts)

        return bound(bound(seen, lambda r: F.struct(r.alias("r"), F.array_min(r).alias("least"))), join)

    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, merge, lambda parts: F.transform(parts, lambda p: rank(p)))
    return bound(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged))


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words, in n log n: the lowest rank first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends = list(range(1, n + 1))  # end of the part that starts here
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else n
            if b < n and (r := ranks.get(word[a : ends[b]])) is not None:
                heapq.heappush(heap, (r, a, ends[b]))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


def _merge_words(ranks):
    """(word, ids) of words given as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for b in batches:
            ids = [merge_by_heap(w.encode(), table) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(PATTERN), F.lit(0))


def _frequency(n: Column) -> Column:
    """A logarithmic class of counts: fewer than 400 of them."""
    return F.floor(F.log2(n) * 6).cast("int")


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """(word): the words of the highest frequency classes that together hold at most ``most`` words. Runs a histogram."""
    held, least = 0, None
    for r in sorted(counts.groupBy(_frequency(F.col("count")).alias("f")).count().collect(), key=lambda r: -r.f):
        held += r["count"]
        if held > most:
            break
        least = r.f
    return counts.where(_frequency(F.col("count")) >= least if least is not None else F.lit(False)).select("word")


class HotWords:
    """Ids of frequent words, by the text of the word, as a literal of the plan."""

    def __init__(self, ids: dict[str, list[int]]) -> None:
        slots: list[dict[str, list[int]] | None] = [None] * BUCKETS
        for word, got in ids.items():
            at = zlib.crc32(word.encode()) % BUCKETS
            slots[at] = {**(slots[at] or {}), word: got}
        self.table = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,array<int>>>")


def encode(documents: DataFrame, key: str, text: str, path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """(key, ids): the ids of each text. Runs a count of all words first."""
    spark = documents.sparkSession
    ranks = Ranks(path or tokenizer_path(spark, "byte_bpe_50k.tiktoken"))
    read = documents.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    counts = keep(read.select(F.explode("words").alias("word")).groupBy("word").count())
    frequent = frequent_words(counts, hot_words)
    hot = HotWords({r.word: r.ids for r in frequent.where(F.octet_length("word") <= FOLD_BYTES).repartition(shuffle_partitions(spark)).select("word", bound(ranks.table, lambda t: fold(byte_string(F.col("word")), _look_up(t))).alias("ids")).collect()})
    long = counts.where(F.octet_length("word") > FOLD_BYTES).select("word")
    has_long = bool(long.take(1))

    def put(x: Column) -> Column:
        words, seen, rank = x["words"], _look_up(x["hot"]), _look_up(x["ranks"])
        known = (lambda w: F.coalesce(seen(w), F.try_element_at(x["given"], w))) if has_long else seen

        def place(q: Column) -> Column:
            return F.flatten(F.transform(q["got"], lambda ids, i: F.coalesce(ids, F.element_at(q["ids"], F.greatest(F.array_position(q["rare"], words[i]).cast("int"), F.lit(1))))))

        def rest(got: Column) -> Column:
            rare = F.array_distinct(F.filter(words, lambda w, i: got[i].isNull()))
            return bound(rare, lambda r: F.struct(got.alias("got"), r.alias("rare"), F.transform(r, lambda w: bound(byte_string(w), lambda b: fold(b, rank))).alias("ids")))

        return bound(bound(F.transform(words, lambda w: known(w)), rest), place)

    tables = [hot.table.alias("hot"), ranks.table.alias("ranks")]
    if not has_long:
        return read.select("key", bound(F.struct("words", *tables), put).alias("ids"))
    # every long word travels with its ids to the documents that have it
    merged = long.mapInArrow(_merge_words(spark.sparkContext.broadcast(ranks.ranks)), "word string, ids array<int>")
    wanted = read.select("key", F.explode(F.array_distinct(F.filter("words", lambda w: F.octet_length(w) > FOLD_BYTES))).alias("word"))
    given = wanted.distinct().join(merged, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "ids"))).alias("given"))
    both = read.join(given, "key", "left")
    return both.select("key", bound(F.struct("words", "given", *tables), put).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(key, text): the text of each list of ids, its binary pieces concatenated; null ids give null."""
    spark = encoded.sparkSession
    ranks = Ranks(path or tokenizer_path(spark, "byte_bpe_50k.tiktoken"))
    pieces = F.array_join(F.transform("ids", lambda i: F.element_at(ranks.pieces, i + 1)), "")
    return encoded.select("key", F.decode(F.unhex(pieces), "UTF-8").alias("text"))
