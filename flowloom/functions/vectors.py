"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(n: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(kind), n)


def abs_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v * v)


def indexed_columns(column: str, prefix: str, n: int) -> list[Column]:
    """Array items as columns `<prefix>000`, `<prefix>001`, ... for a wide sink."""
    return [F.col(column)[i].alias(f"{prefix}{i:03d}") for i in range(n)]
