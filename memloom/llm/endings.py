"""Problem 6: values that were cut before their author's end, and how often each source cuts.

Method: prefix self-join, on two levels. All distinct values, stripped of whatever was put
after the stop, are sorted over explicit range cut points; a value is a strict prefix of a
longer copy elsewhere exactly if a value in the run that follows it in that order goes on
inside a word or sentence. A value that begins the cut point after its range is also sent
to the ranges its run reaches, so no pair is lost at a border. Few cut values have an
untouched copy, but most break off in a sentence whose like occurs elsewhere: so the last,
unfinished sentence of each value is joined, by the hash-keyed prefixes of its masked tokens
(names, figures and codes masked), with the beginnings of all finished sentences.

The joins decide; what they may decide about is told by the ending. A value that ends a
sentence, a list item, a link or a reference code is whole. A fragment in a later sentence,
or one of seven tokens or more, is broken off, and a prefix of three masked tokens and a
character that goes on elsewhere settles it; a single shorter fragment ("6 December 2025",
"my brother is plan") needs five. Only a broken-off fragment that leaves the join nothing to
compare, because it has fewer than two tokens or begins with masks alone, is decided by its
ending. ``decider`` says what decided: 'value', 'sentence' or 'ending'.

Edge cases: null, blank, punctuation-only values and stand-ins for nothing are never
cut; a key delivered more than once counts once; empty tables give no rows; further
columns are ignored; values under ``least`` characters take no part in the join of values,
since a word like "Yes" begins many longer values and is still a whole answer.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import keep, shuffle_partitions

# fixed values: what stands for nothing
STAND_INS = frozenset(["null", "none", "nan", "nil", "n/a", "na", "n.a", "empty", "no response", "continued", "start", "end", "undefined", "unknown", "br", "br/", "p", "p /p", "tbd"])
# fixed values: phrases that end in an ellipsis on purpose
ON_PURPOSE = re.compile(r"(and so on|and so forth|and more|et cetera|etc|usw|und so weiter|und mehr|et ainsi de suite|y así sucesivamente|y más|等等|之类)[.\s]*$", re.I)
BLANK = "\\s\u200b\u200c\u200d\u2060\ufeff\u00ad"
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
LETTERS_AT_END = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
TAIL = re.compile(rf"(?:[{BLANK}]*+(?:\.{{2,}}+|…++|\ufffd++|\[(?:\.\.\.|…|cut|truncated|more)\]|\((?:\.\.\.|…|cut|truncated|more)\)|<(?:cut|truncated)>|[-–—]{{2,}}+))+[{BLANK}\"'”’»)\]]*$", re.I)
IN_TAIL = BLANKS + ".…\ufffd[](){}<>-–—\"'”’»" + "acdemnortuACDEMNORTU"  # every character TAIL can match
CLOSERS = re.compile(rf"[{BLANK}\"'”’»)\]*_`]+$")
FULL_STOP = re.compile(r"[.!?。！？；;]$")
# fixed values: month names that follow a day with a full stop
SPLIT = re.compile(r"(?<=[.!?])(?<!\b\d\.)(?<!\b\d\d\.)\s+|(?<=[.!?])\s+(?!(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)|(?<=[。！？])\s*|\n+")
ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
LINK = re.compile(r"https?://\S+$|\S+@\S+\.\S+$")
ENOUGH = re.compile(r"(?:(?:[^\w<]|_)*+[^\W_]){12}")  # before any markup more letters or digits than a stand-in has
INSIDE = re.compile(r"[^\W_]|,? [^\W_]")
CODE = re.compile(r"\b[A-Z]{2,4}-\d{2,}$")
TOKEN = re.compile(r"[\u3400-\u9fff]|[^\W_]+(?:['’-][^\W_]+)*|[$,:]")
NAME = re.compile(r"^[A-ZÀ-Þ][\w'’-]*$")
# fixed values: capitalised words that open sentences and are not names
OPENERS = frozenset("A An The We They It I My Our For If Let's Please Could Budget Ticket Since So Nothing Nobody Remember What Between Last Right Now As In On To By At From After Given Looking Just For My Wir Das Der Die Den Bitte Letzte Niemand Seit Ich Le La Les Nous Il Je Personne Depuis El Los Hay Nadie Desde Recomiendo La Remember Everyone Someone This That These Those He She You Reference See Open Question Answer".split())


def bare(text: str | None) -> str:
    """What is left of a value without white space, invisible characters, punctuation, markup and stand-ins."""
    if text is None:
        return ""
    if ENOUGH.match(text):
        return text
    plain = re.sub(r"<[^<>]{0,40}>", " ", text)
    plain = re.sub(r"[\W_]+", " ", plain).strip()
    core = re.sub(r"[\s\[\](){}<>\"'*.]+", " ", text).strip().lower()
    return "" if not plain or core in STAND_INS or plain.lower() in STAND_INS else plain


def skeleton(fragment: str) -> list[str]:
    """Tokens with names, figures and codes masked."""
    out = []
    for k, t in enumerate(TOKEN.findall(re.sub(r"\b[A-Z]{2,4}-\d+", " 0ref ", fragment))):
        if t[0].isdigit():
            t = "0ref" if t == "0ref" else "0"
        elif NAME.match(t) and (k > 0 or t not in OPENERS) and ord(t[0]) < 0x3400:
            t = "N" if k > 0 or len(t) > 5 else t.lower()
        out.append(t.lower() if t != "N" else t)
    return out


HEAD = 80  # characters of a sentence that mostly hold the tokens its keys need


def opening_keys(part: str) -> tuple[list[str], bool]:
    """The opening keys of a finished sentence of six tokens or more, and whether all sentences with its first HEAD characters have the same."""
    tokens = skeleton(part[:HEAD])
    settled = len(part) < HEAD or len(tokens) >= 7  # the last token of a beginning may itself be cut
    if not settled:
        tokens = skeleton(part)
    return [k for n in range(1, 6) if (k := opening_key(tokens, n))] if len(tokens) >= 6 else [], settled


def opening_key(tokens: list[str], n: int) -> str:
    """The first n tokens and the first character of the next; empty if there are none or all are masks."""
    if not 0 < n < len(tokens) or all(t in ("N", "0", "0ref", ",", ":", "$") for t in tokens[:n]):
        return ""
    return " ".join(tokens[:n]) + "|" + tokens[n][0]


def broken_key(fragment: str) -> str:
    """The shortest key of three to five tokens of a broken-off fragment, of fewer if it has no more; empty if there is nothing to compare."""
    tokens = skeleton(fragment)
    least = min(3, len(tokens) - 1)
    return next((k for n in range(max(1, least), 6) if (k := opening_key(tokens, n))), "")


def judge(text: str | None) -> tuple[str, str, str, str]:
    """(verdict, stem, key, sign): 'whole', 'cut' (broken off) or 'open'; the value without its tail; the masked opening that settles it; 'mark' if something was put after the stop."""
    if not bare(text):
        return "whole", "", "", ""
    stem = text.rstrip(BLANKS)
    marked = TAIL.search(stem, len(stem.rstrip(IN_TAIL))) if stem[-1:] not in LETTERS_AT_END else None
    if marked:
        body = stem[: marked.start()]
        if not bare(body) or ON_PURPOSE.search(body):
            return "whole", body, "", ""
        if "\ufffd" in marked.group() or not FULL_STOP.search(CLOSERS.sub("", body)):
            body = CLOSERS.sub("", body)
            return "cut", body, broken_key([p for p in SPLIT.split(body) if p.strip()][-1].strip()), "mark"
        return "whole", body, "", ""
    body = CLOSERS.sub("", stem)
    if FULL_STOP.search(body):
        return "whole", body, "", ""
    if stem[-1:] in "}]" or stem.endswith("```") or LINK.search(body):
        return "whole", body, "", ""
    if ON_PURPOSE.search(body):
        return "whole", body, "", ""
    lines = body.split("\n")
    if ITEM.match(lines[-1]):
        return "open", body, "", ""
    parts = [p for p in SPLIT.split(body) if p.strip()]
    last = parts[-1].strip()
    tokens = skeleton(last)
    if CODE.search(last) and len(tokens) <= 3:
        return "open", body, opening_key(tokens, len(tokens) - 1), ""
    if len(parts) > 1 or len(tokens) >= 7 and (last[0].isupper() or ord(last[0]) > 0x3400):
        return "cut", body, broken_key(last), ""
    return "open", body, opening_key(tokens, min(5, len(tokens) - 1)), ""


def _judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [judge(t) for t in b.column("text").to_pylist()]
        cols = [b.column(c) for c in b.schema.names if c != "text"]
        names = [c for c in b.schema.names if c != "text"]
        extra = [pa.array([g[k] for g in got], pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*cols, *extra], names=[*names, "verdict", "stem", "opening", "sign"])


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opening keys of finished sentences, each once per task."""
    seen: set[str] = set()
    heads: set[str] = set()
    for b in batches:
        new = []
        for text in b.column(0).to_pylist():
            for part in SPLIT.split(text) if text else ():
                part = part.strip()
                if part[:HEAD] in heads or not FULL_STOP.search(part[-1:]):
                    continue
                if len(heads) > 500_000:  # caches of what this task has sent
                    heads.clear()
                    seen.clear()
                keys, settled = opening_keys(part)
                if settled:
                    heads.add(part[:HEAD])
                for key in keys:
                    if key not in seen:
                        seen.add(key)
                        new.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["opening"])


def _place(cuts: list[str]):
    keys = [c.encode() for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            once = list(dict.fromkeys(b.column(0).to_pylist()))  # copies need no second row
            stems, at = [], []
            for s in once:
                p = bisect.bisect_right(keys, s.encode())
                stems.append(s)
                at.append(p)
                while p < len(cuts) and cuts[p].startswith(s):  # longer copies lie in the next range too
                    p += 1
                    stems.append(s)
                    at.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(at, pa.int32())], names=["stem", "part"])

    return run


def _strict_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted stems; passes on those that a later stem continues inside a word or sentence."""
    last, part = None, None
    begun: list[str] = []  # prefixes of the last stem, each of the next, that nothing has continued so far
    for b in batches:
        out = []
        for stem, p in zip(b.column("stem").to_pylist(), b.column("part").to_pylist()):
            if p != part:
                begun, last, part = [], None, p
            if stem == last:
                continue
            while begun and not stem.startswith(begun[-1]):
                begun.pop()
            left = []
            for v in begun:
                (out if INSIDE.match(stem, len(v)) else left).append(v)
            begun = [*left, stem]
            last = stem
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["stem"])


def strict_prefixes(values: DataFrame, column: str = "stem", least: int = 8, sample: int = 4_096) -> DataFrame:
    """(stem): values of at least ``least`` characters that are strict prefixes of longer ones. Runs a bounded sample for the cut points first."""
    spark = values.sparkSession
    parts = shuffle_partitions(spark)
    stems = values.where(F.length(column) >= least).select(F.col(column).alias("stem"))
    # a uniform sample of fixed size: the least hash of each of a fixed number of buckets; cut points may be beginnings
    buckets = max(sample, 32 * parts)
    least_of = stems.select(F.xxhash64("stem").alias("h"), F.substring("stem", 1, 64).alias("s")).groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min(F.struct("h", "s")).alias("m"))
    drawn = sorted((r.s for r in least_of.select("m.s").collect()), key=str.encode)
    cuts = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}, key=str.encode) if drawn else []
    placed = stems.mapInArrow(_place(cuts), "stem string, part int")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "stem").mapInArrow(_strict_prefixes, "stem string").distinct()


def endings(values: DataFrame) -> DataFrame:
    """(tab, rec_key, field_name, source, cut, decider) for each record of (tab, rec_key, field_name, source, text)."""
    schema = ", ".join(f"{c} string" for c in ("tab", "rec_key", "field_name", "source", "verdict", "stem", "opening", "sign"))
    texts = values.select("tab", "rec_key", "field_name", "source", "text").dropDuplicates(["tab", "rec_key", "field_name"])
    judged = keep(texts.mapInArrow(_judge_rows, schema))
    longer = strict_prefixes(judged)
    known = values.select("text").mapInArrow(_openings, "opening string").distinct()
    unsure = judged.where("verdict <> 'whole'").join(longer.withColumn("longer", F.lit(True)), "stem", "left")
    settled = unsure.join(known.withColumn("known", F.lit(True)), "opening", "left")
    # a mark put after the stop is itself the sign of a cut, as is a break that leaves nothing to compare
    told = (F.col("sign") == "mark") | ((F.col("verdict") == "cut") & (F.col("opening") == ""))
    decider = F.when(F.col("longer"), "value").when(F.col("known"), "sentence").when(told, "ending")
    found = settled.select("tab", "rec_key", "field_name", decider.alias("decider")).where("decider is not null")
    return judged.select("tab", "rec_key", "field_name", "source").join(found, ["tab", "rec_key", "field_name"], "left").select("tab", "rec_key", "field_name", "source", F.col("decider").isNotNull().alias("cut"), "decider")


def deciders(judged: DataFrame) -> DataFrame:
    """(tab, decider, n_values): how many cut values each step decides."""
    return judged.where("cut").groupBy("tab", "decider").agg(F.count("*").alias("n_values"))


def cut_rates(judged: DataFrame) -> DataFrame:
    """(tab, source, n_values, n_cut, cut_share) per source; only values that are not null count."""
    return judged.groupBy("tab", "source").agg(F.count("*").alias("n_values"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))
