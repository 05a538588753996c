"""Regular lattices of points as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    """nx x ny x nz points at low + spacing * (i, j, k); place i + nx (j + ny k)."""

    low: tuple[float, float, float]
    spacing: tuple[float, float, float]
    dims: tuple[int, int, int]

    @classmethod
    def over(cls, low, high, dims, kind: str = "centroid") -> Lattice:
        """Points of a box cut into ``dims`` cells. centroid: the cells' centres; structured: as many points
        from the first centre on, closer together by (n - 1) / n; vertex: from corner to corner of the box."""
        step = [(b - a) / n for a, b, n in zip(low, high, dims, strict=True)]
        if kind == "vertex":
            return cls(tuple(low), tuple((b - a) / max(1, n - 1) for a, b, n in zip(low, high, dims, strict=True)), tuple(dims))
        start = tuple(a + h / 2 for a, h in zip(low, step, strict=True))
        if kind == "structured":
            step = [h * (n - 1) / n for h, n in zip(step, dims, strict=True)]
        return cls(start, tuple(step), tuple(dims))

    def index(self, i: Column, j: Column, k: Column) -> Column:
        nx, ny, _ = self.dims
        return (i + nx * (j + ny * k)).cast("long")

    def points(self, spark: SparkSession) -> DataFrame:
        nx, ny, nz = self.dims
        at = spark.range(nx * ny * nz).select(F.col("id").alias("idx"), (F.col("id") % nx).cast("int").alias("i"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("j"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("k"))
        return at.select("i", "j", "k", "idx", *[(F.lit(a) + F.lit(h) * F.col(c)).alias(x) for a, h, c, x in zip(self.low, self.spacing, "ijk", "xyz", strict=True)])


def staggered(low, high, dims) -> dict[str, Lattice]:
    """The lattices of a staggered grid: pressures in the centres of cells, each velocity on the faces across its axis."""
    step = [(b - a) / n for a, b, n in zip(low, high, dims, strict=True)]
    out = {"p": Lattice.over(low, high, dims)}
    for axis, name in enumerate("uvw"):
        start = tuple(a if i == axis else a + h / 2 for i, (a, h) in enumerate(zip(low, step, strict=True)))
        out[name] = Lattice(start, tuple(step), tuple(n + (i == axis) for i, n in enumerate(dims)))
    return out
