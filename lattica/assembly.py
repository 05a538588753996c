"""An assembly of particles: read it, cut space around it, and write what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.operators import mesh, octree, spatial
from lattica.sources import files
from lattica.sources.grids import Lattice, staggered


class Assembly:
    """Particles and the box around them; every method gives DataFrames or a new Assembly."""

    def __init__(self, particles: DataFrame, root: octree.Root | None = None):
        self.particles = particles
        if root is None:
            r = spatial.bounding_box(particles).first()
            root = octree.Root(*(tuple(r[f"{e}{a}"] for a in "xyz") for e in "lh"))
        self.root = root
        self.leaves = self.bag = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> Assembly:
        return cls(files.read_particles(spark, path, **how))

    def append(self, particles: DataFrame) -> Assembly:
        return Assembly(self.particles.unionByName(particles))

    def write(self, path: str) -> None:
        files.write_particles(self.particles, path)

    def divide(self, depth: int | None = None) -> Assembly:
        """Cells to a fixed depth, or without one adaptively, while they meet eight particles or more."""
        self.levels = depth or 0
        self.leaves, self.bag = octree.refine(self.particles, self.root, octree.DEEPEST if depth is None else depth, 8 if depth is None else 1)
        return self

    def contains(self, points: DataFrame) -> DataFrame:
        return spatial.points_inside(points, self.particles)

    def lattice(self, dims, kind: str = "centroid") -> Lattice:
        return Lattice.over(self.root.low, self.root.high, dims, kind)

    def mask(self, dims, kind: str = "centroid") -> DataFrame:
        return spatial.lattice_markers(self.particles, self.lattice(dims, kind))

    def staggered_masks(self, dims) -> dict[str, DataFrame]:
        return {n: spatial.lattice_markers(self.particles, g) for n, g in staggered(self.root.low, self.root.high, dims).items()}

    def mesh(self) -> tuple[DataFrame, DataFrame]:
        return mesh.from_cells(self.leaves, self.root)

    def write_mask(self, dims, path: str) -> None:
        files.write_dat(self.mask(dims), dims, path)

    def divide_once(self) -> Assembly:
        """One level deeper than the last division by depth."""
        self.levels = getattr(self, "levels", 0) + 1
        return self.divide(self.levels)

    def write_mesh(self, path: str) -> None:
        files.write_lines(files.mesh_lines(*self.mesh()), path)

    def write_points(self, dims, path: str, kind: str = "structured") -> None:
        from pyspark.sql import functions as F

        files.write_lines(files.points_lines(self.mask(dims, kind), self.lattice(dims, kind), {"pointMarkers": F.col("marker")}), path)
