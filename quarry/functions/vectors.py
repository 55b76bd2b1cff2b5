"""Vector functions as Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.columns import let


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null for zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.transform(s["a"], lambda x: (x.cast("double") / s["n"]).cast("float")))


def has_dimension(a: Column, size: int) -> Column:
    return F.coalesce(F.size(a) == size, F.lit(False))


def hashed_words(text: Column, size: int = 64) -> Column:
    """The default embedding: word counts hashed into `size` places, as doubles. Not normalised."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    # The text is cut into words once, not again for each place.
    return let(places, lambda all_places: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(all_places, lambda p: p == i)).cast("double")))
