"""Word stems by the suffix rules of Porter's paper of 1980, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: suffixes and their replacements, by step
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _runs(stem: str) -> int:
    """How often a consonant follows a vowel."""
    shape = _shape(stem)
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table replaced, if what stands before it is long enough."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _runs(stem) > least else word
    return word


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _runs(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if _runs(w) == 1 and _short_end(w) else w
    return w


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _runs(head) > 1 and (suffix != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        head = w[:-1]
        if _runs(head) > 1 or (_runs(head) == 1 and not _short_end(head)):
            w = head
    return w[:-1] if w.endswith("ll") and _runs(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of a list of tokens; null stays null."""
    for batch in tokens:
        yield batch.map(lambda ws: None if ws is None else [stem(w) for w in ws])
