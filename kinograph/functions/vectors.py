"""Vector arithmetic on array columns; sums run in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, floor: float = 0.0, eps: float = 0.0) -> Column:
    """``v`` over its length, which is kept above ``floor`` or padded with ``eps``."""
    size = F.greatest(norm(v), F.lit(floor)) + F.lit(eps)
    return F.transform(doubles(v), lambda x: F.try_divide(x, size))


def truncate_normalise(v: Column, width: int) -> Column:
    return unit(F.slice(v, 1, width), floor=1e-9)


def mean_vector(values: Column, count: Column) -> Column:
    return F.transform(values, lambda x: x / count)
