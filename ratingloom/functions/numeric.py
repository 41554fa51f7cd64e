"""Column expressions of the models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (factors, ratings) of each step of the number of factors that a user's ratings pay for.
FACTOR_STEPS = ((5, 10), (5, 20), (5, 40), (5, 80), (5, 160))


def tag_weight(count: Column) -> Column:
    """ln(count) + 1."""
    return F.log(count) + F.lit(1.0)


def num_factors(ratings: Column) -> Column:
    """How many factors so many ratings pay for: ever fewer for each further rating, 25 at most."""
    out, done, before = None, 0, 0
    for factors, size in FACTOR_STEPS:
        value = F.floor((ratings - before) / (size // factors)) + done
        out = F.when(ratings <= before + size, value) if out is None else out.when(ratings <= before + size, value)
        done, before = done + factors, before + size
    return out.otherwise(done).cast("int")


def cosine(dot: Column, left: Column, right: Column) -> Column:
    """The cosine from a dot product and two squared norms; null where a norm is 0."""
    return F.try_divide(dot, F.sqrt(left) * F.sqrt(right))


def common_boost(score: Column, common: Column, point: float = 100, limit: float = 0.05) -> Column:
    """score raised by up to ``limit`` for many common raters: in full from ``point`` on, not at all at 3."""
    x = 3 + F.coalesce(F.try_divide((3 * F.exp(F.lit(float(limit))) - 3) * (common - 3), F.lit(float(point - 3))), F.lit(0.0))
    return score * (1 + F.least(F.greatest(F.log(F.greatest(x, F.lit(1e-300))) - F.log(F.lit(3.0)), F.lit(0.0)), F.lit(float(limit))))


def genre_overlap(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct genres share at least half of the smaller one; false if one is empty or null."""
    smaller = F.least(F.size(a), F.size(b))
    return F.coalesce((smaller > 0) & (2 * F.size(F.array_intersect(a, b)) >= smaller), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
