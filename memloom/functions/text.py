"""Scalar text functions. Null text gives an empty list, false, or null, as each docstring says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom import schema as S

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def no_punctuation(text: Column) -> Column:
    """Without the 32 ASCII punctuation characters."""
    return F.translate(text, S.PUNCTUATION, "")


def words(text: Column) -> Column:
    """Split at white space, empty parts dropped; [] for null."""
    return _list(F.filter(F.split(text, SPACE), lambda w: w != ""))


def bm25_tokens(text: Column) -> Column:
    """Lower-case tokens without punctuation, no stemming; [] for null."""
    return words(F.lower(no_punctuation(text)))


def _plain_words(text: Column, stop: list[str], least: int) -> Column:
    parts = F.split(F.lower(text), NOT_WORD)
    return _list(F.filter(parts, lambda w: w.rlike(f"^[a-z]{{{least},}}$") & ~w.isin(stop)))


def keyword_set(text: Column) -> Column:
    """Distinct words of three or more Latin letters that are no stopwords; [] for null."""
    return F.array_distinct(_plain_words(text, S.KEYWORD_STOPWORDS, 3))


def resolver_keywords(text: Column) -> Column:
    """Words for reference resolution, in order, repeats kept; [] for null."""
    return _plain_words(text, S.RESOLVER_STOPWORDS, 3)


def normalised(text: Column) -> Column:
    """Lower case, articles and punctuation out, white space collapsed; '' for null."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(^|[^\p{L}\p{N}_])(a|an|the)(?=[^\p{L}\p{N}_]|$)", "$1 ")
    return F.trim(F.regexp_replace(no_punctuation(bare), SPACE, " "))


def overlap_keywords(text: Column) -> Column:
    """Characters of a text with Han signs, else words of two or more signs that are no stopwords; [] for null."""
    signs = F.filter(F.split(F.regexp_replace(text, NOT_WORD, ""), ""), lambda c: c != "")
    plain = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: (F.length(w) >= 2) & ~w.isin(S.OVERLAP_STOPWORDS))
    return _list(F.when(text.rlike("[一-鿿]"), signs).otherwise(plain))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), F.lit(False))


def count_phrases(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the lower-cased text holds; 0 for null."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.coalesce(low.contains(p), F.lit(False)).cast("int") for p in phrases])


def has_digits(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False))


def has_names(text: Column, version: int = 1) -> Column:
    """A later word that begins upper case; from version 2 not all upper case; in version 3 not after a full stop."""
    parts = words(text)
    later = F.transform(parts, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def named(x: Column) -> Column:
        hit = (x["i"] > 0) & x["w"].rlike(r"^\p{Lu}")
        if version > 1:
            hit = hit & (x["w"] != F.upper(x["w"]))
        if version > 2:
            hit = hit & ~F.get(parts, x["i"] - 1).endswith(".")
        return hit

    return F.exists(later, named)


def is_temporal(text: Column) -> Column:
    return contains_any(text, S.TEMPORAL_WORDS)


def adaptive_k(question: Column, base: int) -> Column:
    """A wider k for questions that need several facts or a time; the base for null."""
    return F.when(contains_any(question, S.MULTIHOP_WORDS), F.lit(max(base, 15))).when(contains_any(question, S.WIDER_WORDS), F.lit(max(base, 12))).otherwise(F.lit(base))


def phrase_pattern(phrases: list[str]) -> str:
    """A pattern for any of the phrases as whole words."""
    return r"\b(?:" + "|".join(phrases) + r")\b"


def complexity(question: Column) -> Column:
    """'complex' for causal, comparative or long questions, else 'simple'."""
    low = F.lower(question)
    hit = low.rlike(phrase_pattern(S.COMPLEX_PHRASES))
    for first, then in S.COMPLEX_PAIRS:
        hit = hit | low.rlike(rf"\b{first}.*{then}\b")
    return F.when(F.coalesce(hit, F.lit(False)) | (F.size(words(question)) > 15), "complex").otherwise("simple")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down; 0 for null."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def fenced_json(text: Column) -> Column:
    """What a code fence holds, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def entity_name(text: Column) -> Column:
    return F.lower(F.trim(text))


def listed(text: Column) -> Column:
    """The texts of the JSON array that a text holds, from its first "[" to its last "]"; without one its lines of more than ten characters; [] for null."""
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda l: F.trim(l)), lambda l: F.length(l) > 10)
    return _list(F.filter(F.coalesce(inner, lines), lambda t: t.isNotNull() & (F.trim(t) != "")))
