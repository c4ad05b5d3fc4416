"""Vector arithmetic on array columns. Everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _double(x) * _double(x))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector has similarity 0 with everything."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def l1_normalise(a: Column) -> Column:
    total = _sum(F.transform(a, lambda x: F.abs(_double(x))))
    return F.transform(a, lambda x: _double(x) / total)


def clamp_at_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal length, and every |x - y| <= atol + rtol * |y|."""
    within = F.zip_with(
        a, b, lambda x, y: F.abs(_double(x) - _double(y)) <= F.lit(atol) + F.lit(rtol) * F.abs(_double(y))
    )
    return (F.size(a) == F.size(b)) & F.forall(within, lambda ok: F.coalesce(ok, F.lit(False)))
