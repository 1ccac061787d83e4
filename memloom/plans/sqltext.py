"""Fragments of SQL that several query modules share."""

from __future__ import annotations

from memloom import schema as S

ART = "art AS (SELECT * FROM artifacts QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
FACTS = "fct AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY loaded_at) = 1)"
RESULTS = "res AS (SELECT * FROM fact_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY asked_at) = 1)"
ENTRIES = "ent AS (SELECT * FROM archive_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY created_at) = 1)"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(text: str, phrases: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({text}), {quoted([p])})" for p in phrases) + ", false)"


def count_of(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(contains(lower({text}), {quoted([p])}), false)::INT" for p in phrases) + ")"


PUNCT = quoted([S.PUNCTUATION])


def words(text: str) -> str:
    return f"coalesce(list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda w: w <> ''), [])"


def bm25(text: str) -> str:
    return words(f"lower(translate({text}, {PUNCT}, ''))")


def plain(text: str, stop: list[str], least: int = 3) -> str:
    return f"coalesce(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}') AND w NOT IN ({quoted(stop)})), [])"


def keywords(text: str) -> str:
    return f"list_distinct({plain(text, S.KEYWORD_STOPWORDS)})"


def normalised(text: str) -> str:
    # RE2 has no lookahead: the same articles go out in two passes
    once = r"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    step = f"lower(coalesce({text}, ''))"
    for _ in range(3):
        step = once.format(t=step)
    return f"trim(regexp_replace(translate({step}, {PUNCT}, ''), '{SPACE}', ' ', 'g'))"


def joined(items: str) -> str:
    """A list as one comparable string."""
    return f"array_to_string(list_sort({items}), ' ')"
