"""Vector functions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_vector(text: Column, centred: bool = True) -> Column:
    """Sixteen numbers from the bytes of the text's MD5; repeated 24 times they are the 384 of the mock model,
    and every cosine is the same. Null counts as empty."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    shift = 0.5 if centred else 0.0
    return F.array(*[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 255 - F.lit(shift) for i in range(16)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero. One-element arrays bind the vector and its norm, so each is evaluated once."""
    sized = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.transform(sized, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or unequally long vectors."""
    both = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0)
    return F.coalesce(F.when(fits, dot(a, b) / both), F.lit(0.0))


def usable(a: Column, dim: int) -> Column:
    """Of this length, without null or NaN, not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))
