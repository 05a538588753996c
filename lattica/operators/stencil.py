"""Finite differences on periodic grids: fields are (i, j, k, v), absent or solid places count as 0.

A solid place is a row of a mask (i, j, k); results there are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["i", "j", "k"]


def shifted(field: DataFrame, axis: int, by: int, n: int, name: str) -> DataFrame:
    """Values by the place that sees them ``by`` steps along the axis, round a grid of n."""
    a = PLACE[axis]
    return field.select(*[F.pmod(F.col(c) - by, F.lit(n)).cast("int").alias(c) if c == a else F.col(c) for c in PLACE], F.col("v").alias(name))


def gather(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """The sum of fields times factors: one union and one aggregation for all, instead of a join for each."""
    every = reduce(DataFrame.unionByName, [f.select(*PLACE, (F.col("v") * w).alias("v")) for f, w in parts])
    return every.groupBy(*PLACE).agg(F.sum("v").alias("v"))


def fluid(field: DataFrame, solid: DataFrame | None) -> DataFrame:
    return field if solid is None else field.join(solid.select(*PLACE), PLACE, "left_anti")


def laplacian(field: DataFrame, dims, spacing, solid: DataFrame | None = None) -> DataFrame:
    """The seven-point Laplacian, periodic, at places that aren't solid."""
    parts = [(field, -2 * sum(1 / h**2 for h in spacing))]
    for axis, (n, h) in enumerate(zip(dims, spacing, strict=True)):
        parts += [(shifted(field, axis, by, n, "v"), 1 / h**2) for by in (-1, 1)]
    return fluid(gather(parts), solid)


def difference(field: DataFrame, dims, spacing, axis: int, other: int, solid: DataFrame | None = None) -> DataFrame:
    """(v here - v ``other`` steps along the axis) / h: other = 1 is the negative forward difference, -1 the backward one."""
    h = spacing[axis]
    return fluid(gather([(field, 1 / h), (shifted(field, axis, other, dims[axis], "v"), -1 / h)]), solid)


def pressure_laplacian(field: DataFrame, dims, spacing, solids: dict[str, DataFrame] | None = None) -> DataFrame:
    """Sum over axes of a difference of a difference, both negative forward, with the masks of pressures and velocities."""
    solids = solids or {}
    parts = [(difference(difference(field, dims, spacing, a, 1, solids.get("uvw"[a])), dims, spacing, a, 1, solids.get("p")), 1.0) for a in range(3)]
    return gather(parts)


def combine(*parts: tuple[DataFrame, float]) -> DataFrame:
    return gather(list(parts))


def face_average(field: DataFrame, axis: int) -> DataFrame:
    """A velocity on faces, averaged to the centres of cells: half of v here and one step on."""
    a = PLACE[axis]
    nxt = field.select(*[(F.col(c) - 1).alias(c) if c == a else F.col(c) for c in PLACE], F.col("v").alias("w"))
    return field.join(nxt, PLACE).select(*PLACE, ((F.col("v") + F.col("w")) / 2).alias("v"))
