"""Vector arithmetic as column expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_l2(a, b))


def inner(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One less the inner product, of unit vectors."""
    return F.lit(1.0) - inner(a, b)


def normalised(v: Column | str) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = F.sqrt(inner(v, v))
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def gaussian(d2: Column, sigma: Column) -> Column:
    """exp(-d2 / (2 sigma**2))."""
    return F.exp(-d2 / (2 * sigma * sigma))
