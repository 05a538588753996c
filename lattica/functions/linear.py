"""Planes, 3 x 3 matrices (rows of Columns) and dense matrices as long tables (i, j, v)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import quat

V = tuple[Column, Column, Column]


def vdot(a: V, b: V) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def vcross(a: V, b: V) -> V:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def vsub(a: V, b: V) -> V:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def unit(a: V) -> V:
    n = F.sqrt(vdot(a, a))
    return tuple(x / n for x in a)


@dataclass(frozen=True)
class Plane:
    """A plane with an orthonormal frame (normal and two axes within it)."""

    origin: V
    normal: V

    @classmethod
    def of(cls, origin: V, normal: V) -> Plane:
        return cls(origin, unit(normal))

    @classmethod
    def through(cls, p1: V, p2: V, p3: V) -> Plane:
        return cls(p1, unit(vcross(vsub(p3, p1), vsub(p2, p1))))

    @property
    def frame(self) -> tuple[V, V]:
        """The first axis is the normal's cross product with x, or with y where the normal is nearer to x."""
        n = self.normal
        near = F.abs(n[0]) > 0.9
        axis = (F.when(near, 0.0).otherwise(1.0), F.when(near, 1.0).otherwise(0.0), F.lit(0.0))
        a = unit(vcross(n, axis))
        return a, vcross(n, a)

    def distance(self, p: V) -> Column:
        """Signed, along the normal."""
        return vdot(vsub(p, self.origin), self.normal)

    def project(self, p: V) -> V:
        d = self.distance(p)
        return tuple(x - d * n for x, n in zip(p, self.normal, strict=True))

    def to_local(self, p: V) -> V:
        a, b = self.frame
        r = vsub(p, self.origin)
        return vdot(r, a), vdot(r, b), vdot(r, self.normal)

    def to_global(self, p: V) -> V:
        a, b = self.frame
        return tuple(o + p[0] * x + p[1] * y + p[2] * z for o, x, y, z in zip(self.origin, a, b, self.normal, strict=True))

    def rotate(self, q: quat.Q) -> Plane:
        return Plane(self.origin, quat.rotate(q, self.normal))


M = tuple[V, V, V]


def det(m: M) -> Column:
    return vdot(m[0], vcross(m[1], m[2]))


def trace(m: M) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


def column(m: M, j: int) -> V:
    return tuple(r[j] for r in m)


def transpose(m: M) -> M:
    return tuple(column(m, j) for j in range(3))


def matvec(m: M, v: V) -> V:
    return tuple(vdot(r, v) for r in m)


def matmul(a: M, b: M) -> M:
    t = transpose(b)
    return tuple(tuple(vdot(r, c) for c in t) for r in a)


def madd(a: M, b: M) -> M:
    return tuple(tuple(x + y for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True))


def mscale(m: M, s) -> M:
    return tuple(tuple(x * s for x in r) for r in m)


def inverse(m: M) -> M:
    """By the adjugate; null elements for a singular matrix."""
    d = det(m)
    cofactors = (vcross(m[1], m[2]), vcross(m[2], m[0]), vcross(m[0], m[1]))
    return tuple(tuple(F.try_divide(c[i], d) for c in cofactors) for i in range(3))


def solve(m: M, v: V) -> V:
    """Cramer's rule."""
    return matvec(inverse(m), v)


# ---- dense matrices ------------------------------------------------------------


def dense(spark: SparkSession, rows: int, cols: int, value: Column) -> DataFrame:
    """(i, j, v) for every place; value may use columns i and j."""
    at = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    return at.select("i", "j", value.cast("double").alias("v"))


def hilbert(spark: SparkSession, n: int) -> DataFrame:
    return dense(spark, n, n, 1.0 / (F.col("i") + F.col("j") + 1))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return dense(spark, n, n, (F.col("i") == F.col("j")).cast("double"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(b, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("k").alias("j"), "v")


def times(a: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix by vector (i, v)."""
    x = x.select(F.col("i").alias("j"), F.col("v").alias("w"))
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def dense_trace(a: DataFrame) -> DataFrame:
    return a.filter("i = j").agg(F.sum("v").alias("trace"))
