"""Vector expressions over ARRAY<FLOAT>; all sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column | str, b: Column | str, f) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """Null for a zero vector."""
    return F.transform(_col(a), lambda x: x.cast("double") / F.nullif(l2_norm(a), F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column | str, b: Column | str) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def quantize(a: Column | str, scale: float = 127.0) -> Column:
    """Values of -1 to 1 as int8, halves away from zero; values beyond are held at the ends."""
    return F.transform(_col(a), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * scale))).cast("tinyint"))
