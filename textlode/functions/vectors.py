"""Vector arithmetic on array columns, in double, summed from the first element to the last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column | str) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; null for a zero vector."""
    v = _col(v)
    length = norm(v)
    # The length goes in as an array: inside the lambda it would be computed anew for every element.
    lengths = F.array_repeat(length, F.size(v))
    return F.when(length > 0, F.zip_with(v, lengths, lambda x, n: x.cast("double") / n))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    def square(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return total(F.zip_with(_col(a), _col(b), square))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def argmax(scores: Column | str) -> Column:
    """Position of the largest score, from 0; the first one wins."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
