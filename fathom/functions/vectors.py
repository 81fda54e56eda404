"""Vector expressions on arrays, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b| + 1e-8); 0 for zero vectors."""
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def normalised(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero; what rounds to zero keeps its sign (-0.0), as in SQL."""
    out = F.round(x, digits)
    return F.when(out == 0, x * 0.0).otherwise(out)


def truncated(a: Column, dims: int) -> Column:
    return F.slice(a, 1, dims)


def max_sim(query: Column, page: Column) -> Column:
    """Late interaction: the sum over query vectors of the largest dot product with a page vector."""
    return F.aggregate(F.transform(query, lambda t: F.array_max(F.transform(page, lambda u: dot(t, u)))), F.lit(0.0), lambda s, v: s + v)


def packed_signs(a: Column) -> Column:
    """One bit per dimension (positive or not), eight to a number, minus 128."""
    bits = F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0))
    starts = F.sequence(F.lit(0), F.size(a) - 8, F.lit(8))
    return F.transform(starts, lambda i: F.aggregate(F.slice(bits, i + 1, 8), F.lit(0), lambda s, b: s * 2 + b) - 128)


def parts(a: Column, width: int) -> Column:
    """The array in consecutive pieces of `width`."""
    return F.transform(F.sequence(F.lit(0), F.size(a) - width, F.lit(width)), lambda i: F.slice(a, i + 1, width))
