"""Vector arithmetic on array columns, in double precision over float storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add_scaled(h: Column, d: Column, alpha: Column) -> Column:
    return F.zip_with(doubles(h), doubles(d), lambda x, y: x + alpha * y)


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def slices(a: Column, width: int, count: int) -> Column:
    """An array cut into `count` consecutive arrays of `width`."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(a, k * width + 1, width))
