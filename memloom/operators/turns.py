"""Turns and history: building turns from messages, compaction windows, retained turns, chunks, postings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vectors as V


def messages(entries: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the two sides of each turn as messages; blank ones drop out."""
    each = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("user_text").alias("text")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")))
    flat = entries.select("conv_id", "turn_id", "entry_id", F.explode(each).alias("m")).where(F.trim(F.coalesce("m.text", F.lit(""))) != "")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_id", "entry_id", "m.side"))
    return flat.withColumn("seq", seq).select("conv_id", "seq", "m.role", "m.text")


def turns(m: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): a turn begins where the user speaks after the assistant; runs are joined by a line end."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    begins = (F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("assistant")) == "assistant")
    numbered = m.withColumn("turn", F.greatest(F.sum(begins.cast("int")).over(w), F.lit(1)).cast("int"))

    def side(role: str, filler: str):
        said = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "text"))))
        return F.coalesce(F.nullif(F.array_join(F.transform(said, lambda x: x["text"]), "\n"), F.lit("")), F.lit(filler))

    return numbered.groupBy("conv_id", "turn").agg(side("user", "[Continued]").alias("user"), side("assistant", "[No response]").alias("assistant"))


def windows(entries: DataFrame, sessions: DataFrame, retain: int = 5) -> DataFrame:
    """(conv_id, entry_id, n, bucket, kept): count windows of the session's size; the last ``retain`` of each window stay in the history."""
    size = sessions.groupBy("conv_id").agg(F.max("compact_every").alias("every"))
    order = Window.partitionBy("conv_id").orderBy("turn_id", "entry_id")
    n = entries.select("conv_id", "turn_id", "entry_id", F.row_number().over(order).alias("n")).join(size, "conv_id", "left")
    bucket = n.withColumn("bucket", F.floor((F.col("n") - 1) / F.coalesce("every", F.lit(40))).cast("int"))
    back = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(F.desc("n")))
    return bucket.withColumn("kept", back <= retain).select("conv_id", "entry_id", "n", "bucket", "kept")


def phases(entries: DataFrame, at: int = 40, retain: int = 5) -> DataFrame:
    """(conv_id, entry_id, phase): one compaction after ``at`` turns: 'compressed', 'retained' or 'live'."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_id", "entry_id"))
    phase = F.when(F.col("n") > at, "live").when(F.col("n") > at - retain, "retained").otherwise("compressed")
    return entries.withColumn("n", n).select("conv_id", "entry_id", phase.alias("phase"))


def duologue(m: DataFrame, least: int = 0) -> DataFrame:
    """(conv_id, turn, user, assistant) of messages (conv_id, seq, role, text), runs of one speaker joined on both sides.

    A turn ends where the user speaks after the assistant. What is missing reads "[Start]" for the user's side, "[Continued]" in the
    last turn, and "[End]" for the assistant's. Conversations of fewer than ``least`` messages drop out.
    """
    w = Window.partitionBy("conv_id").orderBy("seq")
    begins = (F.col("role") == "user") & (F.lag("role").over(w) == "assistant")
    numbered = m.withColumn("turn", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(w).cast("int") + 1)

    def side(role: str):
        said = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "text"))))
        return F.nullif(F.array_join(F.transform(said, lambda x: x["text"]), "\n"), F.lit(""))

    joined = numbered.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), side("user").alias("u"), side("assistant").alias("a"))
    ends = joined.groupBy("conv_id").agg(F.max("turn").alias("last"), F.sum("n").alias("n_messages")).where(F.col("n_messages") >= least)
    missing = F.when(F.col("turn") == F.col("last"), "[Continued]").otherwise("[Start]")
    return joined.join(ends, "conv_id").select("conv_id", "turn", F.coalesce("u", missing).alias("user"), F.coalesce("a", F.lit("[End]")).alias("assistant"))


def should_compress(entries: DataFrame, artifacts: DataFrame, shift: float = 0.55, sparse: float = 0.5) -> DataFrame:
    """(conv_id, entry_id, turn, compress, reason) of each turn, counted from 0: 'too_soon' before 20, 'turn_limit' from 60 on,
    'topic_shift' where the mean vectors of the last five and the five before part, 'low_density' where few artifacts were made, else 'none'.

    Running means come from prefix sums of vectors, so a conversation is summed, not collected.
    """
    order = Window.partitionBy("conv_id").orderBy("turn_id", "entry_id")
    text = F.concat_ws(" ", F.coalesce("user_text", F.lit("")), F.coalesce("assistant_text", F.lit("")))
    rows = entries.select("conv_id", "entry_id", "turn_id", V.unit(V.hash_vector(text)).alias("v")).withColumn("turn", F.row_number().over(order) - 1)
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    last, before = by_turn.rowsBetween(-4, 0), by_turn.rowsBetween(-9, -5)
    both = rows.select("conv_id", "entry_id", "turn", *[F.avg(F.col("v")[k]).over(w).alias(f"{n}{k}") for n, w in (("r", last), ("p", before)) for k in range(16)])
    r, p = (F.array(*[F.col(f"{n}{k}") for k in range(16)]) for n in ("r", "p"))
    alike = both.select("conv_id", "entry_id", "turn", F.when(F.col("turn") >= 14, F.round(V.cosine(r, p), 6)).alias("alike"))
    made = artifacts.select("conv_id", F.explode(F.sequence(F.col("turn_id"), F.col("turn_id") + 10)).alias("turn")).groupBy("conv_id", "turn").agg(F.count("*").alias("made"))
    told = alike.join(made, ["conv_id", "turn"], "left")
    reason = (
        F.when(F.col("turn") < 20, "too_soon")
        .when(F.col("turn") >= 60, "turn_limit")
        .when(F.col("alike") < shift, "topic_shift")
        .when(F.coalesce("made", F.lit(0)) / 10 < sparse, "low_density")
        .otherwise("none")
    )
    return told.select("conv_id", "entry_id", "turn", (~reason.isin("too_soon", "none")).alias("compress"), reason.alias("reason"))


def batches(entries: DataFrame, size: int = 10) -> DataFrame:
    """(conv_id, batch, text, n): every ``size`` turns as one text with markers."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn_id", "entry_id"))
    marked = F.concat(F.lit("[Turn "), F.col("turn_id"), F.lit("] User: "), F.coalesce("user_text", F.lit("")), F.lit("\nAssistant: "), F.coalesce("assistant_text", F.lit("")))
    rows = entries.withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("int")).select("conv_id", "batch", "n", marked.alias("line"))
    return rows.groupBy("conv_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("text"), F.count("*").alias("n"))


def postings(entries: DataFrame) -> DataFrame:
    """(conv_id, keyword, n_entries, first_entry): the inverted keyword index."""
    words = entries.select("conv_id", "entry_id", F.explode(F.array_distinct(F.transform("keywords", lambda k: F.lower(F.trim(k))))).alias("keyword")).where("keyword is not null and keyword <> ''")
    return words.groupBy("conv_id", "keyword").agg(F.count("*").alias("n_entries"), F.min("entry_id").alias("first_entry"))


def chunk_walk(entries: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """(conv_id, chunk, start, end, text, turns): a conversation's text in chunks that end at a line end of their last fifth where there is one.

    Each chunk's start depends on the one before, so a conversation is walked in order by one task; it streams past, and only
    the text from the current chunk on is held.
    """
    marked = F.concat(F.lit("[Turn "), F.col("turn_id"), F.lit("] User: "), F.coalesce("user_text", F.lit("")), F.lit("\nAssistant: "), F.coalesce("assistant_text", F.lit("")), F.lit("\n\n"))
    rows = entries.select("conv_id", "turn_id", "entry_id", marked.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "turn_id", "entry_id")
    names = ["conv_id", "chunk", "start", "end", "text", "turns"]

    class Walk:
        """The tail of one conversation: text from ``base`` on, and the turns that reach into it."""

        def __init__(self, conv: str) -> None:
            self.conv, self.base, self.start, self.text, self.spans, self.n = conv, 0, 0, "", [], 0

        def cut(self, ends: bool) -> list[tuple]:
            out = []
            while self.start < self.base + len(self.text) and (ends or self.start + size < self.base + len(self.text)):
                stop = self.base + len(self.text)
                end = min(self.start + size, stop)
                if end < stop:
                    at = self.text.rfind("\n", max(self.start, end - size // 5) - self.base, end - self.base)
                    end = self.base + at + 1 if at >= 0 else end
                turns = [t for a, b, t in self.spans if b > self.start and a < end]
                out.append((self.conv, self.n, self.start, end, self.text[self.start - self.base : end - self.base], turns))
                self.n += 1
                if end >= stop and ends:
                    self.start = stop
                    break
                back = end - overlap
                self.start = end if back <= 0 or back >= end else back
                self.spans = [s for s in self.spans if s[1] > self.start]
                self.text, self.base = self.text[self.start - self.base :], self.start
            return out

        def add(self, turn: int, line: str) -> None:
            at = self.base + len(self.text)
            self.spans.append((at, at + len(line), turn))
            self.text += line

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk: Walk | None = None
        for b in batches:
            out: list[tuple] = []
            for c, t, line in zip(b.conv_id, b.turn_id, b.line):
                if walk is None or walk.conv != c:
                    out += walk.cut(True) if walk else []
                    walk = Walk(c)
                walk.add(int(t), line)
                out += walk.cut(False)
            yield pd.DataFrame(out, columns=names)
        if walk:
            yield pd.DataFrame(walk.cut(True), columns=names)

    return rows.mapInPandas(run, "conv_id string, chunk int, start int, end int, text string, turns array<int>")
