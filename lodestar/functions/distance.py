"""Distances between vectors as Column expressions, in double precision, summed from the left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def same_length(a: Column, b: Column) -> Column:
    """True, or an error that names both lengths; nulls pass. ``zip_with`` alone would pad with nulls."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("vectors of different lengths: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))).otherwise(F.lit(True))


def _fold(a: Column, b: Column, term) -> Column:
    total = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(same_length(a, b), total)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def residual(a: Column, centre: Column) -> Column:
    return F.when(same_length(a, centre), F.zip_with(a.cast("array<double>"), centre.cast("array<double>"), lambda x, y: x - y))


def unit_direction(origin: Column, point: Column) -> Column:
    """The unit vector from ``origin`` to ``point``; null where they coincide."""
    d = residual(point, origin)
    norm = F.nullif(F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(d, lambda x: x / norm))


def hybrid(e: Column, s: Column, alpha: Column) -> Column:
    """The distance that weighs two components by alpha: s + alpha (e - s)."""
    return s + alpha * (e - s)


def finite(vector: Column) -> Column:
    """Whether every component is a finite number; ingest rejects other vectors, whose order isn't total."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
