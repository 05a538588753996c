"""Particles as rows: kind, radii, exponents, centre and the rotation from global to local axes.

Columns: particle_id, kind (superellipsoid, sphere, prism, ellipsoid), rx, ry, rz,
eps1, eps2, x, y, z, q0..q3. Level functions are 1 on the surface; a particle is
closed. Exponents lie in (0, 2): the shape is convex, its support function is a
dual norm, and its bounding box follows in closed form.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lattica.functions import quat
from lattica.functions.box import Box
from lattica.functions.vec import sgn

V = tuple[Column, Column, Column]
COLUMNS = ["rx", "ry", "rz", "eps1", "eps2", "x", "y", "z", "q0", "q1", "q2", "q3"]


def _c(*names: str) -> tuple[Column, ...]:
    return tuple(map(F.col, names))


ROTATION = [f"m{i}{j}" for i in range(3) for j in range(3)]


def prepared(particles: DataFrame) -> DataFrame:
    """particles with their rotation matrix (m00..m22), worked out once; all else here reads it from there."""
    if "m00" in particles.columns:
        return particles
    m = quat.matrix(quat.of())
    return particles.select("*", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])


def rotation() -> tuple[V, V, V]:
    return tuple(_c(*ROTATION[3 * i : 3 * i + 3]) for i in range(3))


def to_local(p: V) -> V:
    d = [a - b for a, b in zip(p, _c("x", "y", "z"), strict=True)]
    return tuple(r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in rotation())


def to_global(p: V) -> V:
    m = rotation()
    return tuple(m[0][j] * p[0] + m[1][j] * p[1] + m[2][j] * p[2] + c for j, c in enumerate(_c("x", "y", "z")))


def superellipsoid_level(p: V) -> Column:
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    square = lambda u, r: F.pow(u / r, F.lit(2.0))
    inner = F.pow(square(p[0], a), 1 / e2) + F.pow(square(p[1], b), 1 / e2)
    return F.pow(inner, e2 / e1) + F.pow(square(p[2], c), 1 / e1)


def sphere_level(p: V) -> Column:
    return (p[0] * p[0] + p[1] * p[1] + p[2] * p[2]) / (F.col("rx") * F.col("rx"))


def prism_level(p: V) -> Column:
    return F.greatest(*[F.abs(u / r) for u, r in zip(p, _c("rx", "ry", "rz"), strict=True)])


def ellipsoid_level(p: V) -> Column:
    a, b, c = (u / r for u, r in zip(p, _c("rx", "ry", "rz"), strict=True))
    return F.sqrt(a * a + b * b + c * c)


def level(p: V) -> Column:
    """Level of a global point for the row's kind."""
    q = to_local(p)
    kind = F.col("kind")
    return F.when(kind == "sphere", sphere_level(q)).when(kind == "prism", prism_level(q)).when(kind == "ellipsoid", ellipsoid_level(q)).otherwise(superellipsoid_level(q))


def contains(p: V) -> Column:
    return level(p) <= 1


def reach(d: V) -> Column:
    """Support function of the centred particle along the local direction d: how far it reaches."""
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    u, v, w = (F.abs(x * r) for x, r in zip(d, (a, b, c), strict=True))
    p, q = 2 / (2 - e2), 2 / (2 - e1)
    flat = F.pow(F.pow(u, p) + F.pow(v, p), 1 / p)
    general = F.pow(F.pow(flat, q) + F.pow(w, q), 1 / q)
    kind = F.col("kind")
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return F.when(kind == "sphere", a * n).when(kind == "prism", u + v + w).when(kind == "ellipsoid", F.sqrt(u * u + v * v + w * w)).otherwise(general)


def support(d: V) -> V:
    """The particle's point furthest along a global direction (not 0): the gradient of the support function."""
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    l = [r[0] * d[0] + r[1] * d[1] + r[2] * d[2] for r in rotation()]  # noqa: E741
    u, v, w = (F.abs(x * r) for x, r in zip(l, (a, b, c), strict=True))
    p, q = 2 / (2 - e2), 2 / (2 - e1)
    flat = F.pow(F.pow(u, p) + F.pow(v, p), 1 / p)
    h = F.pow(F.pow(flat, q) + F.pow(w, q), 1 / q)
    share = lambda x, y, k: F.when(y > 0, F.pow(x / y, k)).otherwise(0.0)
    general = (share(flat, h, q - 1) * share(u, flat, p - 1) * a, share(flat, h, q - 1) * share(v, flat, p - 1) * b, share(w, h, q - 1) * c)
    n = F.sqrt(l[0] * l[0] + l[1] * l[1] + l[2] * l[2])
    round_ = F.sqrt(u * u + v * v + w * w)
    kind, out = F.col("kind"), []
    for x, r, g, m in zip(l, (a, b, c), general, (u, v, w), strict=True):
        out.append(sgn(x) * F.when(kind == "sphere", a * F.abs(x) / n).when(kind == "prism", r).when(kind == "ellipsoid", m * r / round_).otherwise(g))
    return to_global(tuple(out))


def closest_point(p: V) -> V:
    """The particle's point furthest towards a global point p (not the centre)."""
    return support(tuple(a - b for a, b in zip(p, _c("x", "y", "z"), strict=True)))


def moved(particles: DataFrame, dx, dy, dz) -> DataFrame:
    """particles with their centres shifted (by numbers or columns)."""
    return particles.withColumns({c: F.col(c) + d for c, d in zip("xyz", (dx, dy, dz), strict=True)})


def turned(particles: DataFrame, q: tuple) -> DataFrame:
    """particles turned round their centres by a unit quaternion (numbers or columns), from local into global axes."""
    a, b, c, d = (F.col(f"q{i}") for i in range(4))
    w, x, y, z = (F.lit(q[0]), *(-F.lit(v) for v in q[1:]))  # ours turn global into local axes: the inverse turn comes first, on the right
    out = (a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w)
    return particles.drop(*ROTATION).withColumns({f"q{i}": v for i, v in enumerate(out)})


def resized(particles: DataFrame, factor) -> DataFrame:
    """particles with radii times a factor (a number or column)."""
    return particles.withColumns({c: F.col(c) * factor for c in ("rx", "ry", "rz")})


def obb_bounds() -> Box:
    """Axis-aligned bounds of the oriented bounding box's corners."""
    r, out = rotation(), [[], []]
    radii = [F.when(F.col("kind") == "sphere", F.col("rx")).otherwise(F.col(c)) for c in ("rx", "ry", "rz")]
    for j, c in enumerate(_c("x", "y", "z")):
        h = sum((F.abs(r[i][j]) * radii[i] for i in (1, 2)), F.abs(r[0][j]) * radii[0])
        out[0].append(c - h)
        out[1].append(c + h)
    return Box(tuple(out[0]), tuple(out[1]))


def aabb() -> Box:
    """Tight bounding box: the reach along each axis."""
    r = rotation()
    out = [[], []]
    for j, c in enumerate(_c("x", "y", "z")):
        h = reach(tuple(row[j] for row in r))
        out[0].append(c - h)
        out[1].append(c + h)
    return Box(tuple(out[0]), tuple(out[1]))


def _pow(x: float, y: float) -> float:
    try:
        return math.pow(x, y)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if x == 0 else math.nan


def _reach(u: float, v: float, w: float, e1: float, e2: float) -> float:
    if e1 == 2 or e2 == 2:
        return math.nan
    p, q = 2 / (2 - e2), 2 / (2 - e1)
    return _pow(_pow(_pow(_pow(u, p) + _pow(v, p), 1 / p), q) + _pow(w, q), 1 / q)


def _library_reaches(kind: pd.Series, *c: pd.Series) -> pd.Series:
    out = [None] * len(kind)
    at = (~kind.isin(("sphere", "prism", "ellipsoid"))).to_numpy().nonzero()[0]
    for n, a, b, d, e1, e2, *m in zip(at.tolist(), *(x.to_numpy(float)[at].tolist() for x in c), strict=True):
        out[n] = [None if math.isnan(h := _reach(abs(m[j] * a), abs(m[3 + j] * b), abs(m[6 + j] * d), e1, e2)) else h for j in range(3)]
    return pd.Series(out, dtype=object)


_library_reaches.__annotations__ = {"kind": pd.Series, "c": pd.Series, "return": pd.Series}


def library_aabb() -> Box:
    """aabb with powers of the C library, as SQL engines take them: the JVM's differ in the last bit, and boxes that touch tell it."""
    r, kind = rotation(), F.col("kind")
    far = F.pandas_udf(_library_reaches, ArrayType(DoubleType()))(kind, *_c("rx", "ry", "rz", "eps1", "eps2", *ROTATION))
    low, high = [], []
    for j, c in enumerate(_c("x", "y", "z")):
        h = F.when(kind.isin("sphere", "prism", "ellipsoid"), reach(tuple(row[j] for row in r))).otherwise(F.get(far, F.lit(j)))
        low.append(c - h)
        high.append(c + h)
    return Box(tuple(low), tuple(high))


def obb_corner(n: Column) -> V:
    """Corner n (voxel order) of the oriented bounding box."""
    bit = lambda i: F.when(F.shiftright(n, i).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    radii = F.when(F.col("kind") == "sphere", F.col("rx"))
    return to_global(tuple(bit(i) * F.coalesce(radii, r) for i, r in enumerate(_c("rx", "ry", "rz"))))


def parametric(eta: Column, omega: Column) -> V:
    """A local surface point of a superellipsoid; level 1."""
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    power = lambda x, e: sgn(x) * F.pow(F.abs(x), e)
    ce, se, co, so = F.cos(eta), F.sin(eta), F.cos(omega), F.sin(omega)
    return a * power(ce, e1) * power(co, e2), b * power(ce, e1) * power(so, e2), c * power(se, e1)


def normal_parametric(eta: Column, omega: Column) -> V:
    """A local direction normal to the surface at parametric(eta, omega)."""
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    power = lambda x, e: sgn(x) * F.pow(F.abs(x), e)
    ce, se, co, so = F.cos(eta), F.sin(eta), F.cos(omega), F.sin(omega)
    return power(ce, 2 - e1) * power(co, 2 - e2) / a, power(ce, 2 - e1) * power(so, 2 - e2) / b, power(se, 2 - e1) / c


#: Lanczos' coefficients for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """Gamma function for x > 0."""
    z = x - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * s


def beta(a: Column, b: Column) -> Column:
    return gamma(a) * gamma(b) / gamma(a + b)


def volume() -> Column:
    a, b, c, e1, e2 = _c("rx", "ry", "rz", "eps1", "eps2")
    kind, round_ = F.col("kind"), 4 * math.pi / 3
    general = 2 * a * b * c * e1 * e2 * beta(e1 / 2, 1 + e1) * beta(e2 / 2, 1 + e2 / 2)
    return F.when(kind == "sphere", round_ * a * a * a).when(kind == "prism", 8 * a * b * c).when(kind == "ellipsoid", round_ * a * b * c).otherwise(general)


def diam() -> Column:
    a, b, c = _c("rx", "ry", "rz")
    return F.when(F.col("kind") == "sphere", 2 * a).otherwise(2 * F.sqrt(a * a + b * b + c * c))
