"""Vector arithmetic with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Cosine; 0 where a vector is null or nearly zero."""
    n = norm(a) * norm(b)
    return F.when(F.coalesce(n, F.lit(0.0)) > floor, dot(a, b) / n).otherwise(0.0)


def drift(a: Column, b: Column) -> Column:
    """1 less the cosine, the cosine kept between 0 and 1; 4 digits."""
    return F.round(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))), 4)


def temporal_weights(rows: Column) -> Column:
    """Rows of a matrix weighted from 0.5 (oldest) to 1 (latest), one after the other."""
    n = F.size(rows)
    w = lambda i: F.when(n > 1, 0.5 + 0.5 * i / (n - 1)).otherwise(1.0)
    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda x: x * w(i))))
