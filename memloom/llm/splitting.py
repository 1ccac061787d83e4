"""Problem 3: items above a size limit, cut into overlapping pieces at natural boundaries.

Method: dynamic programming over boundary positions. Candidate cuts are the ends of
paragraphs, turns, lines, sentences, clauses and words, each with a penalty; where a
stretch has none, cuts inside it are allowed at a high penalty. Among all ways to cut a
text into pieces of at most ``limit`` characters, each starting about ``overlap``
characters (at a word start where there is one) before the end of the piece before, the
one with the least sum of penalties and squared deviations from equal size is taken.

Lengths are in Unicode code points. A piece carries those of ``source_turns`` whose text
it overlaps: a turn begins at its marker ``[Turn n]``; text before the first marker
belongs to the latest earlier turn in ``source_turns``, or, without any marker, to all.

Edge cases: null, empty and short texts give no pieces (they need none); null
``source_turns`` give null turns, unsorted or repeated ones come out sorted and once; a
repeated key counts once; texts without any boundary are cut hard; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, SLACK = 512, 100, 20
BALANCE = 2.0  # weight of the squared relative deviation from equal size
HARD, STRETCH = 6.0, 128
# position after the match is a cut; later rules override the penalty of earlier ones
BOUNDARIES = (
    (1.5, re.compile(r"\s+")),
    (0.8, re.compile(r"[,;:，；：、](?:\s+|(?<=[，；：、]))")),
    (0.3, re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][”’」）]*")),
    (0.15, re.compile(r"[^\S\n]*\n\s*")),
    (0.05, re.compile(r"\s*\n\s*\n\s*")),
)
TURN = re.compile(r"\[Turn (\d+)\]")
TURN_CUT = 0.0


def cuts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions in 1..len(text) and their penalties; the end of the text is free.

    Cuts after words and clauses, and hard cuts, are candidates only inside stretches of more
    than STRETCH characters that have no stronger boundary.
    """
    at: dict[int, float] = {}
    for penalty, rule in BOUNDARIES[2:]:
        for m in rule.finditer(text):
            at[m.end()] = penalty
    for m in TURN.finditer(text):
        at[m.start()] = TURN_CUT
    at.pop(0, None)
    at[len(text)] = 0.0
    for penalty, rule in (BOUNDARIES[1], BOUNDARIES[0], (HARD, None)):
        places = sorted(at)
        for a, b in zip([0, *places], places):
            if b - a > STRETCH:
                for p in [m.end() for m in rule.finditer(text, a, b)] if rule else range(a + STRETCH // 2, b, STRETCH // 2):
                    if a < p < b:
                        at.setdefault(p, penalty)
    places = np.array(sorted(at), np.int64)
    return places, np.array([at[p] for p in places.tolist()])


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; one piece if the text is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    places, penalty = cuts_of(text)
    # where a piece starts whose predecessor ends at each cut: the word start nearest to overlap characters before
    words = np.array([0, *[m.end() for m in BOUNDARIES[0][1].finditer(text)]], np.int64)
    wish = np.maximum(places - overlap, 0)
    right = np.minimum(np.searchsorted(words, wish), len(words) - 1)
    left = np.maximum(right - 1, 0)
    near = np.where(np.abs(words[right] - wish) <= np.abs(words[left] - wish), words[right], words[left])
    starts = np.where(np.abs(near - wish) <= SLACK, near, wish)
    starts = np.maximum(np.minimum(starts, places - 1), 0)
    step = limit - overlap
    target = (n - overlap) / max(1, -(-(n - overlap) // step)) + overlap
    k = len(places)
    best = np.full(k, np.inf)
    before = np.full(k, -1, np.int64)
    first = places <= limit
    best[first] = penalty[first] + BALANCE * ((places[first] - target) / target) ** 2
    # cuts are in order, so the predecessors that reach cut b form a window
    low = np.searchsorted(np.maximum.accumulate(starts), places - limit, "left")
    for b in range(k):
        a = low[b]
        if a < b:
            size = places[b] - starts[a:b]
            cost = best[a:b] + penalty[b] + BALANCE * ((size - target) / target) ** 2
            cost[size > limit] = np.inf
            j = int(np.argmin(cost))
            if cost[j] < best[b]:
                best[b], before[b] = cost[j], a + j
    out, b = [], k - 1
    while b >= 0:
        a = int(before[b])
        out.append((int(starts[a]) if a >= 0 else 0, int(places[b])))
        b = a
    return out[::-1]


def turns_of(text: str, pieces: list[tuple[int, int]], turns: list[int] | None) -> list[list[int] | None]:
    """For each piece those of ``turns`` that it overlaps."""
    if turns is None:
        return [None] * len(pieces)
    known = sorted({t for t in turns if t is not None})
    marks = [(m.start(), int(m.group(1))) for m in TURN.finditer(text)]
    if not marks:
        return [known] * len(pieces)
    spans = [(s, marks[k + 1][0] if k + 1 < len(marks) else len(text), t) for k, (s, t) in enumerate(marks)]
    earlier = [t for t in known if t < marks[0][1]]
    if earlier and text[: marks[0][0]].strip():
        spans.insert(0, (0, marks[0][0], earlier[-1]))
    have = set(known)
    return [sorted({t for s, e, t in spans if s < b and e > a and t in have}) for a, b in pieces]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("key", "piece", "start", "end", "text", "turns")}
            for key, text, turns in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                pieces = split(text, limit, overlap)
                for k, ((a, b), covered) in enumerate(zip(pieces, turns_of(text, pieces, turns))):
                    for c, v in zip(cols, (key, k, a, b, text[a:b], covered)):
                        cols[c].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))

    return run


def split_items(items: DataFrame, key: str, text: str, turns: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, end, text, turns): the pieces of every item longer than ``limit``."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    large = items.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(turns).cast("array<int>").alias("turns")).where(F.length("text") > limit)
    return large.dropDuplicates(["key"]).mapInArrow(_pieces(limit, overlap), "key long, piece int, start int, end int, text string, turns array<int>")
