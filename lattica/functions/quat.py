"""Quaternions as four columns (q0, q1, q2, q3); functions take and give 4-tuples of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Q = tuple[Column, Column, Column, Column]
V = tuple[Column, Column, Column]


def of(prefix: str = "q") -> Q:
    return tuple(F.col(f"{prefix}{i}") for i in range(4))


def conj(q: Q) -> Q:
    return (q[0], -q[1], -q[2], -q[3])


def neg(q: Q) -> Q:
    return tuple(-x for x in q)


def scale(q: Q, s) -> Q:
    return tuple(x * s for x in q)


def add(a: Q, b: Q) -> Q:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Q, b: Q) -> Q:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def norm2(q: Q) -> Column:
    return q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]


def norm(q: Q) -> Column:
    return F.sqrt(norm2(q))


def inv(q: Q) -> Q:
    n = norm2(q)
    return tuple(x / n for x in conj(q))


def normalize(q: Q) -> Q:
    n = norm(q)
    return tuple(x / n for x in q)


def mul(a: Q, b: Q) -> Q:
    """Hamilton's product."""
    (a0, a1, a2, a3), (b0, b1, b2, b3) = a, b
    return (a0 * b0 - a1 * b1 - a2 * b2 - a3 * b3, a0 * b1 + a1 * b0 + a2 * b3 - a3 * b2, a0 * b2 - a1 * b3 + a2 * b0 + a3 * b1, a0 * b3 + a1 * b2 - a2 * b1 + a3 * b0)


def div(a: Q, b: Q) -> Q:
    return mul(a, inv(b))


def eq(a: Q, b: Q) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])


def from_axis_angle(angle: Column, axis: V) -> Q:
    n = F.sqrt(axis[0] ** 2 + axis[1] ** 2 + axis[2] ** 2)
    return (F.cos(angle / 2), *(F.sin(angle / 2) * a / n for a in axis))


def angle(q: Q) -> Column:
    return 2 * F.acos(q[0])


def axis(q: Q) -> V:
    n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(F.try_divide(x, n) for x in q[1:])


def matrix(q: Q) -> tuple[V, V, V]:
    """Rows of the matrix of v -> q v q*; a quaternion that isn't a unit scales by its squared norm."""
    w, x, y, z = q
    return (
        (w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z),
    )


def rotate(q: Q, v: V) -> V:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in matrix(q))
