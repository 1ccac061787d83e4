"""Entities of a text by rules that are built from tables of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.temporal import MONTHS

# fixed values: units, names of technology by group, and capitalised words that are no names
UNITS = ["gb", "tb", "mb", "kb", "%", "requests?", "hours?", "minutes?", "days?", "weeks?", "engineers?", "developers?", "dollars?", r"\$"]
MORE_UNITS = ["seconds?", "months?", "years?", "people"]
TECHNOLOGY = ["postgresql", "mysql", "mongodb", "sqlite", "redis", "memcached", "fastapi", "flask", "django", "express", "react", "vue", "angular", "aws", "azure", "gcp", "google cloud", "digitalocean", "docker", "kubernetes", "terraform", "oauth", "jwt", "api key"]
MORE_TECHNOLOGY = ["node.js", "api", "sdk", "cli", "ansible", "jenkins", "gitlab ci", "github actions"]
NO_NAMES = "the a an and or but for nor so yet it is in on at".split()

# patterns both engines read alike; the first group is the entity
AMOUNT = r"\b(\d+(?:\.\d+)?\s*(?:" + "|".join(UNITS + MORE_UNITS) + r")\b)"
NUMBER, UNIT = r"(\d+(?:\.\d+)?)\s*(?:" + "|".join(UNITS) + ")", r"\d+(?:\.\d+)?\s*(" + "|".join(UNITS) + ")"
MONTH_DAY = r"\b((?:" + "|".join(MONTHS) + r")\s+\d{1,2}(?:st|nd|rd|th)?\b)"
MONEY = r"(\$[\d,]+(?:\.\d{2})?)"
QUOTED = '"([^"]+)"'
MAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b)"
LINK = r"(https?://\S+|www\.\S+)"
PHONE = r"\b((?:\d{3}[-.\s]?)?\d{3}[-.\s]?\d{4}\b)"
NAME = r"\b([A-Z][a-z0-9]+\b)"
TOOL = r"\b(" + "|".join(TECHNOLOGY) + r")\b"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 1), F.array().cast("array<string>"))


def keywords(text: Column) -> Column:
    """Distinct lower-case keywords of nine kinds, sorted: amounts with units, dates, technology, money, quoted terms, mail and web addresses, telephone numbers, names; [] for null."""
    low = F.lower(text)
    known = F.filter(F.array(*[F.lit(t) for t in sorted({*TECHNOLOGY, *MORE_TECHNOLOGY} - {"vue"})]), lambda t: low.contains(t))
    quoted = F.filter(_all(text, QUOTED), lambda q: F.length(q) < 50)
    parts = [_all(low, AMOUNT), _all(low, MONTH_DAY), F.coalesce(known, F.array().cast("array<string>")), _all(text, MONEY), quoted, _all(low, MAIL), _all(low, LINK), _all(low, PHONE), F.filter(_all(text, NAME), lambda w: ~F.lower(w).isin(NO_NAMES))]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*parts)), F.lower)))


def _of_type(names: Column, kind: str) -> Column:
    return F.transform(names, lambda x: F.struct(F.lower(F.trim(x)).alias("name"), F.lit(kind).alias("type")))


def typed(text: Column) -> Column:
    """Distinct (name, type) of a text, names in lower case: TECHNOLOGY, NUMBER (with its unit, or money) and CONCEPT (quoted terms of 3 to 49 characters)."""
    low = F.lower(text)
    numbers = F.zip_with(_all(low, NUMBER), _all(low, UNIT), lambda n, u: F.concat_ws(" ", n, u))
    terms = F.filter(_all(text, QUOTED), lambda q: F.length(q).between(3, 49))
    groups = [(_all(low, TOOL), "TECHNOLOGY"), (F.concat(numbers, _all(text, MONEY)), "NUMBER"), (terms, "CONCEPT")]
    named = [_of_type(c, kind) for c, kind in groups]
    return F.array_distinct(F.concat(*named))
