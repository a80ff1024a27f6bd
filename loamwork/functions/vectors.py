"""Column functions on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return total(x) / F.greatest(F.size(x), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: inside a lambda over positions it would be computed for each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(x: Column) -> Column:
    """V9: x over its length; a zero vector stays."""
    return once(norm(x), lambda n: F.transform(x, lambda v: v / F.when(n == 0, 1.0).otherwise(n)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def finite(x: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def profile(x: Column, extra_log: bool = True) -> Column:
    """Coverage columns, by default with one more log1p."""
    return F.transform(x, F.log1p) if extra_log else x


def shape(x: Column) -> Column:
    """X less its own mean: the pattern without the level."""
    return once(mean(x), lambda m: F.transform(x, lambda v: v - m))


def shape_z(x: Column, median: Column, sd: Column) -> Column:
    """The mean of |x - median| / sd."""
    return mean(F.zip_with(F.zip_with(x, median, lambda a, b: F.abs(a - b)), sd, lambda a, b: a / b))


def jaccard(a: Column, b: Column) -> Column:
    """U4: shared over all members of two sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
