"""Vectors of any length as ARRAY<DOUBLE> columns, and points as STRUCT<x, y, z>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def neg(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def add(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    """Elementwise quotient; null where a divisor is 0."""
    return _zip(a, b, lambda x, y: F.try_divide(x, y))


def scale(a: Column, s: Column | float) -> Column:
    return F.transform(a, lambda x: x * s)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def norm2(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(norm2(a))


def infnorm(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def dist2(a: Column, b: Column) -> Column:
    return norm2(sub(a, b))


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(dist2(a, b))


def dist_inf(a: Column, b: Column) -> Column:
    return infnorm(sub(a, b))


def normalize(a: Column) -> Column:
    """The vector over its norm; its elements are null for the zero vector."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    return F.array(*[g(a, i) * g(b, j) - g(a, j) * g(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def el_min(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.least(x, y))


def el_max(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.greatest(x, y))


def argmax(a: Column) -> Column:
    """The first place (from 0) of the largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def _every(a: Column, b: Column, f) -> Column:
    return F.forall(_zip(a, b, f), lambda t: t)


def lt(a: Column, b: Column) -> Column:
    """Cone order: every component is less. Neither order need hold between two vectors."""
    return _every(a, b, lambda x, y: x < y)


def le(a: Column, b: Column) -> Column:
    return _every(a, b, lambda x, y: x <= y)


def gt(a: Column, b: Column) -> Column:
    return lt(b, a)


def ge(a: Column, b: Column) -> Column:
    return le(b, a)


def eq(a: Column, b: Column) -> Column:
    return a == b


def fill(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def to_string(a: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit(")"))


def support(points: Column, d: Column) -> Column:
    """The point of an array of points (arrays) that reaches furthest along d; the first on ties."""
    reach = F.transform(points, lambda p: dot(p, d))
    return F.get(points, argmax(reach))


def mean(points: Column, n: int = 3) -> Column:
    part = lambda i: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(i)))
    return F.array(*[part(i) / F.size(points) for i in range(n)])


def standard_simplex(n: int = 3) -> Column:
    """The origin and the unit vectors."""
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(n)]) for i in range(-1, n)])


def sgn(x: Column) -> Column:
    """-1 below 0 and 1 from 0 on."""
    return F.when(x < 0, -1.0).otherwise(1.0)


def lincomb(*terms: Column) -> Column:
    return reduce(lambda a, b: a + b, terms)
