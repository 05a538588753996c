"""Iterative solvers over fields (i, j, k, v): each step is a few aggregations, and results are written between steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import stencil
from lattica.operators.ids import settle

PLACE = stencil.PLACE


def dot(a: DataFrame, b: DataFrame) -> float:
    both = a.select(*PLACE, "v").join(b.select(*PLACE, F.col("v").alias("w")), PLACE)
    return both.agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("s")).first()["s"]


def norm2(a: DataFrame) -> float:
    """The dot product of a field with itself, which needs no join."""
    return a.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("s")).first()["s"]


def conjugate_gradient(apply: Callable[[DataFrame], DataFrame], b: DataFrame, steps: int = 10, x: DataFrame | None = None, small: float = 1e-16) -> DataFrame:
    """x with apply(x) near b, for a symmetric definite operator; ends at a squared residual under ``small``."""
    r = settle(b if x is None else stencil.combine((b, 1.0), (apply(x), -1.0)))
    x = b.select(*PLACE, F.lit(0.0).alias("v")) if x is None else x
    p, rr = r, norm2(r)
    for _ in range(steps):
        if abs(rr) < small:
            break
        ap = settle(apply(p))
        curve = dot(p, ap)
        if curve == 0:
            break
        alpha = rr / curve
        x = settle(stencil.combine((x, 1.0), (p, alpha)))
        r = settle(stencil.combine((r, 1.0), (ap, -alpha)))
        rr, before = norm2(r), rr
        p = settle(stencil.combine((r, 1.0), (p, rr / before)))
    return x


def distributive_relaxation(fields: dict[str, DataFrame], rhs: dict[str, DataFrame], dims, spacing, solids: dict[str, DataFrame] | None = None, steps: int = 10) -> dict[str, DataFrame]:
    """One step for velocities u, v, w and pressure p: relax momentum along each axis, then mass, and distribute its correction."""
    solids, out = solids or {}, dict(fields)
    lap = lambda name: lambda f: stencil.laplacian(f, dims, spacing, solids.get(name))
    grad = lambda f, a: stencil.difference(f, dims, spacing, a, 1, solids.get("uvw"[a]))
    div = lambda f, a: stencil.difference(f, dims, spacing, a, 1, solids.get("p"))
    for a, name in enumerate("uvw"):
        r = settle(stencil.combine((rhs[name], 1.0), (grad(out["p"], a), -1.0), (lap(name)(out[name]), -1.0)))
        out[name] = settle(stencil.combine((out[name], 1.0), (conjugate_gradient(lap(name), r, steps), 1.0)))
    r = settle(stencil.combine((rhs["p"], 1.0), *[(div(out[name], a), -1.0) for a, name in enumerate("uvw")]))
    mass = lambda f: stencil.pressure_laplacian(f, dims, spacing, solids)
    e = settle(conjugate_gradient(mass, r, steps))
    for a, name in enumerate("uvw"):
        out[name] = settle(stencil.combine((out[name], 1.0), (grad(e, a), 1.0)))
    out["p"] = settle(stencil.combine((out["p"], 1.0), (mass(e), -1.0)))
    return out


#: A sweep's rows follow each other, so the matrix is held in one task: a dense one of so many rows takes 32 MB.
MOST_ROWS = 2048


def gauss_seidel(a: DataFrame, b: DataFrame, sweeps: int = 50) -> DataFrame:
    """x (i, v) with A x near b, for a matrix (i, j, v) of at most MOST_ROWS rows: sweeps go row by row, in one task. Larger ones are refused; see conjugate_gradient."""
    import numpy as np
    import pandas as pd

    most = a.agg(F.greatest(F.max("i"), F.max("j")).alias("n")).first()["n"]
    if most is not None and most >= MOST_ROWS:
        raise ValueError(f"a matrix of over {MOST_ROWS} rows isn't solved in one task")
    rows = a.select("i", "j", "v").unionByName(b.select("i", F.lit(-1).alias("j"), "v"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        m = f[f.j >= 0]
        n = int(max(m.i.max(), m.j.max())) + 1
        dense, rhs = np.zeros((n, n)), np.zeros(n)
        dense[m.i, m.j] = m.v
        rhs[f[f.j < 0].i] = f[f.j < 0].v
        x = np.zeros(n)
        for _ in range(sweeps):
            for i in range(n):
                x[i] = (rhs[i] - dense[i] @ x + dense[i, i] * x[i]) / dense[i, i]
        return pd.DataFrame({"i": np.arange(n, dtype="int32"), "v": x})

    return rows.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(solve, "i int, v double")


def nelder_mead(f: Callable, start, steps: int = 25, reflect: float = 1.0, expand: float = 2.0, contract: float = 0.5, shrink: float = 0.5, stop: float | None = None):
    """(point, value) least found by the simplex method from the simplex ``start`` (n + 1 points); plain numpy, for use in tasks."""
    import numpy as np

    x = np.array(start, float)
    v = np.array([f(p) for p in x])
    for _ in range(steps):
        order = np.argsort(v, kind="stable")
        x, v = x[order], v[order]
        if stop is not None and v[0] <= stop:
            break
        c = x[:-1].mean(0)
        r = c + reflect * (c - x[-1])
        fr = f(r)
        if fr < v[0]:
            e = c + expand * (r - c)
            fe = f(e)
            x[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            x[-1], v[-1] = r, fr
        else:
            k = c + contract * ((r if fr < v[-1] else x[-1]) - c)
            fk = f(k)
            if fk < min(fr, v[-1]):
                x[-1], v[-1] = k, fk
            else:
                x[1:] = x[0] + shrink * (x[1:] - x[0])
                v[1:] = [f(p) for p in x[1:]]
    i = int(np.argmin(v))
    return x[i], float(v[i])


def line_search(f: Callable, low: float, high: float, steps: int = 60) -> tuple[float, float]:
    """The least of a function with one valley on an interval, by thirds."""
    for _ in range(steps):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    x = (low + high) / 2
    return x, f(x)


def coordinate_search(f: Callable, low, high, rounds: int = 20):
    """The least in a box, one coordinate after another."""
    import numpy as np

    low, high = np.array(low, float), np.array(high, float)
    x = (low + high) / 2
    for _ in range(rounds):
        for i in range(len(x)):
            x[i] = line_search(lambda t, i=i: f(np.where(np.arange(len(x)) == i, t, x)), low[i], high[i])[0]
    return x, f(x)
