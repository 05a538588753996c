"""Whether convex particles and cells meet: quick column tests first, then an exact one over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import shapes
from lattica.functions.box import Box
from lattica.operators.inside import Particles

#: Gaps under about a thousandth of the particle may need more steps to be proved, and count as touching.
MOST_STEPS = 256


def may_meet(cell: Box) -> Column:
    """Separating axes of the cell and of the particle's oriented box: false only where they are apart."""
    rows = shapes.rotation()
    sphere = F.col("kind") == "sphere"
    radii = [F.when(sphere, F.col("rx")).otherwise(F.col(c)) for c in ("rx", "ry", "rz")]
    half = [s / 2 * (1 + 1e-9) for s in cell.side]  # bounds are rounded; the exact test decides
    gap = [c - F.col(x) for c, x in zip(cell.center, "xyz", strict=True)]
    out = F.lit(True)
    for j in range(3):
        out = out & (F.abs(gap[j]) <= half[j] + sum((F.abs(rows[i][j]) * radii[i] for i in range(1, 3)), F.abs(rows[0][j]) * radii[0]))
    for i in range(3):
        along = rows[i][0] * gap[0] + rows[i][1] * gap[1] + rows[i][2] * gap[2]
        out = out & (F.abs(along) <= radii[i] + F.abs(rows[i][0]) * half[0] + F.abs(rows[i][1]) * half[1] + F.abs(rows[i][2]) * half[2])
    return out


def sphere_meets(cell: Box) -> Column:
    return cell.distance2((F.col("x"), F.col("y"), F.col("z"))) <= F.col("rx") * F.col("rx")


def _matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    return np.stack([np.stack(r, -1) for r in ((w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)), (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)), (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z))], -2)


def particle_support(d: np.ndarray, r: np.ndarray, e: np.ndarray, kind: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Points of the centred particles furthest along d."""
    l = np.einsum("nij,nj->ni", m, d)  # noqa: E741
    e = np.where((kind == "superellipsoid")[:, None], e, 1.0)
    r = np.where((kind == "sphere")[:, None], r[:, :1], r)
    t = np.abs(l * r)
    p, q = 2 / (2 - e[:, 1]), 2 / (2 - e[:, 0])
    t /= np.maximum(t.max(1, keepdims=True), 1e-300)
    flat = (t[:, 0] ** p + t[:, 1] ** p) ** (1 / p)
    h = (flat**q + t[:, 2] ** q) ** (1 / q)
    share = lambda a, b, k: np.where(b > 0, a / np.where(b > 0, b, 1), 0) ** k
    outer = share(flat, h, q - 1)
    s = np.stack([outer * share(t[:, 0], flat, p - 1), outer * share(t[:, 1], flat, p - 1), share(t[:, 2], h, q - 1)], 1)
    s = np.where((kind == "prism")[:, None], 1.0, s) * r * np.where(l < 0, -1.0, 1.0)
    return np.einsum("nij,ni->nj", m, s)


def holds(p: np.ndarray, kind: np.ndarray, r: np.ndarray, e: np.ndarray, center: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether each row's point lies in its particle, and not just at the surface."""
    out = np.zeros(len(p), bool)
    for k in ("sphere", "prism", "ellipsoid", "superellipsoid"):
        at = np.flatnonzero(kind == k)
        some = Particles(k, np.concatenate([r[at], e[at], center[at], m[at].reshape(-1, 9)], 1))
        out[at] = some.norm(some.local(p[at])) <= 1 - 1e-9
    return out


def meet(low: np.ndarray, high: np.ndarray, f: pd.DataFrame) -> np.ndarray:
    """For each row, whether box and particle meet: their difference is searched for the origin.

    A direction along which all of the difference lies beyond the origin proves
    them apart; without one after MOST_STEPS steps they count as touching. The
    test is the same at any scale.
    """
    kind, r, e = f["kind"].to_numpy(), f[["rx", "ry", "rz"]].to_numpy(float), f[["eps1", "eps2"]].to_numpy(float)
    center, m = f[["x", "y", "z"]].to_numpy(float), _matrices(f[["q0", "q1", "q2", "q3"]].to_numpy(float))
    v = (low + high) / 2 - center
    apart = np.zeros(len(f), bool)
    # The search takes most steps over pairs that overlap; the box's point next to the particle's centre settles nearly all of those.
    live = np.flatnonzero(~holds(np.clip(center, low, high), kind, r, e, center, m))
    for _ in range(MOST_STEPS):
        d = v[live]
        box = np.where(-d > 0, high[live], low[live])
        s = box - center[live] - particle_support(d, r[live], e[live], kind[live], m[live])
        gap = (d * s).sum(1)
        apart[live] = gap > 0
        side = d - s
        t = np.clip((d * side).sum(1) / np.maximum((side * side).sum(1), 1e-300), 0, 1)
        v[live] = d - t[:, None] * side
        go = ~(gap > 0) & ((v[live] ** 2).sum(1) > 1e-24 * ((high[live] - low[live]) ** 2).sum(1)) & (t > 0)
        live = live[go]
        if not len(live):
            break
    return ~apart


def meeting(pairs: DataFrame) -> DataFrame:
    """Rows of pairs (a cell lx..hz and a particle's columns) that meet; spheres never leave the JVM."""
    cell = Box.of()
    spheres = pairs.filter(F.col("kind") == "sphere").filter(sphere_meets(cell))
    near = pairs.filter(F.col("kind") != "sphere").filter(may_meet(cell))

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[meet(f[["lx", "ly", "lz"]].to_numpy(float), f[["hx", "hy", "hz"]].to_numpy(float), f)] if len(f) else f

    others = near.mapInPandas(test, near.schema)
    return spheres.unionByName(others)
