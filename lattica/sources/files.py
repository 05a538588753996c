"""Particle lists, voxel masks (.dat) and legacy ASCII VTK files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.shapes import COLUMNS
from lattica.operators.ids import numbered
from lattica.sources.grids import Lattice


#: What gives the order of lines: file, place of the split in it, place in the split.
LINE = ["file", "block", "line"]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line) of text files; sorted by LINE they stand as in the files, which are taken in order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("line", F.monotonically_increasing_id())


def read_particles(spark: SparkSession, path: str, kind: str = "superellipsoid", conjugate: bool = True) -> DataFrame:
    """Particles of a text file: 12 numbers a line, parted by white space; blank lines and those with # are skipped.

    The file's quaternions turn local axes into global ones; with ``conjugate``
    (the default) they are turned round, as all of this package expects. Ids
    follow the order of lines. A sphere's radius is a third of the sum of radii.
    """
    lines = lines_of(spark, path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.select(*LINE, F.lit(kind).alias("kind"), *[F.get(part, F.lit(i)).cast("double").alias(c) for i, c in enumerate(COLUMNS)])
    if conjugate:
        rows = rows.withColumns({c: -F.col(c) for c in ("q1", "q2", "q3")})
    if kind == "sphere":
        r = (F.col("rx") + F.col("ry") + F.col("rz")) / 3
        rows = rows.withColumn("r", r).withColumns({c: F.col("r") for c in ("rx", "ry", "rz")}).drop("r")
    return numbered(rows, LINE, "particle_id").select("particle_id", "kind", *COLUMNS)


def write_particles(particles: DataFrame, path: str, conjugate: bool = True) -> None:
    """The inverse of read_particles, in the order of particle_id."""
    sign = lambda c: -F.col(c) if conjugate and c in ("q1", "q2", "q3") else F.col(c)
    body = particles.select(F.col("particle_id").alias("at"), F.concat_ws("\t", *[F.format_string("%.17e", sign(c)) for c in COLUMNS]).alias("value"))
    head = particles.sparkSession.createDataFrame([(-1, "#" + "\t".join(COLUMNS))], "at long, value string")
    head.unionByName(body).orderBy("at").select("value").write.mode("overwrite").text(path)


def read_dat(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(i, j, k, idx, marker) and the size of a voxel mask: nx= ny= nz= lines, then markers with i running fastest.

    Blank lines may stand anywhere.
    """
    lines = lines_of(spark, path).filter(F.trim("value") != "")
    head = lines.filter(F.col("value").contains("=")).select(F.regexp_extract("value", r"n([xyz])\s*=", 1).alias("axis"), F.regexp_extract("value", r"=\s*(\d+)", 1).cast("int").alias("n"))
    size = {r["axis"]: r["n"] for r in head.limit(3).collect()}
    nx, ny, nz = (size[a] for a in "xyz")
    rows = lines.filter(~F.col("value").contains("=")).select(*LINE, F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "token"))
    got = numbered(rows, [*LINE, "at"], "idx").select("idx", F.col("token").cast("int").alias("marker"))
    return got.select((F.col("idx") % nx).cast("int").alias("i"), (F.floor(F.col("idx") / nx) % ny).cast("int").alias("j"), F.floor(F.col("idx") / (nx * ny)).cast("int").alias("k"), "idx", "marker"), (nx, ny, nz)


def dat_lines(mask: DataFrame, dims: tuple[int, int, int], blank_first: bool = False) -> DataFrame:
    """(section, k, j, value) lines of a mask (i, j, k, marker) with every place present; a blank line ends each k, or begins it."""
    spark, (nx, ny, nz) = mask.sparkSession, dims
    body = mask.groupBy("k", "j").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "marker"))), lambda s: s["marker"].cast("int").cast("string")), " ").alias("value"))
    blank = spark.range(nz).select(F.lit(1).alias("section"), F.col("id").cast("int").alias("k"), F.lit(-1 if blank_first else ny).alias("j"), F.lit("").alias("value"))
    head = spark.createDataFrame([(0, 0, i, f"n{a}= {n}") for i, (a, n) in enumerate(zip("xyz", dims, strict=True))], "section int, k int, j int, value string")
    return head.unionByName(body.select(F.lit(1).alias("section"), "k", "j", "value")).unionByName(blank)


def write_dat(mask: DataFrame, dims: tuple[int, int, int], path: str, blank_first: bool = False) -> None:
    dat_lines(mask, dims, blank_first).orderBy("section", "k", "j").select("value").write.mode("overwrite").text(path)


def _sections(spark: SparkSession, parts: list) -> DataFrame:
    """Lines in order: each part is a list of strings or a frame (seq, value)."""
    out = None
    for n, p in enumerate(parts):
        lines = spark.createDataFrame(list(enumerate(p)), "seq long, value string") if isinstance(p, list) else p
        lines = lines.select(F.lit(n).alias("section"), F.col("seq").cast("long").alias("seq"), "value")
        out = lines if out is None else out.unionByName(lines)
    return out


HEADER = ["# vtk DataFile Version 3.0", "voxel data", "ASCII"]


def mesh_lines(nodes: DataFrame, elements: DataFrame, marker: str | None = "marker", node_marker: str | None = None, name: str = "elemMarkers") -> DataFrame:
    """(section, seq, value) lines of an unstructured grid: nodes (node_id, x, y, z), elements (elem_id, vtk_type, nodes).

    ``marker`` is a column of elements that is written as scalars ``name``, and
    ``node_marker`` one of nodes, written as nodeMarkers.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    m, size = elements.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("nodes") + 1), F.lit(0))).first()
    if not n or not m:
        raise ValueError("an empty mesh can't be written")
    parts = [
        [*HEADER, "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"], nodes.select(F.col("node_id").alias("seq"), F.concat_ws(" ", "x", "y", "z").alias("value")),
        [f"CELLS {m} {size}"], elements.select(F.col("elem_id").alias("seq"), F.concat_ws(" ", F.size("nodes"), F.array_join(F.col("nodes").cast("array<string>"), " ")).alias("value")),
        [f"CELL_TYPES {m}"], elements.select(F.col("elem_id").alias("seq"), F.col("vtk_type").cast("string").alias("value")),
    ]
    if marker:
        parts += [[f"CELL_DATA {m}", f"SCALARS {name} int", "LOOKUP_TABLE default"], elements.select(F.col("elem_id").alias("seq"), F.col(marker).cast("int").cast("string").alias("value"))]
    if node_marker:
        parts += [[f"POINT_DATA {n}", "SCALARS nodeMarkers int", "LOOKUP_TABLE default"], nodes.select(F.col("node_id").alias("seq"), F.col(node_marker).cast("int").cast("string").alias("value"))]
    return _sections(spark, parts)


def dat_to_vtk(spark: SparkSession, dat: str, low, high, path: str) -> None:
    """The voxels of a .dat mask over a box as an unstructured grid, each with its marker as the scalar ``centroid``."""
    from lattica.operators import mesh

    mask, dims = read_dat(spark, dat)
    write_lines(mesh_lines(*mesh.from_mask(mask, low, high, dims), name="centroid"), path)


def staggered_lines(fields: dict[str, DataFrame], lattice: Lattice, solid: DataFrame | None = None) -> DataFrame:
    """Lines of a staggered grid as structured points at its cells: pressure (0 in solids) and the faces' velocities averaged.

    fields: u, v, w on lower faces and p in cells, as (i, j, k, v); u has a further
    layer of faces along its axis, and so have the others.
    """
    from lattica.operators.stencil import PLACE, face_average, fluid

    grid = lattice.points(fields["p"].sparkSession).select("idx", *PLACE)
    for name, f in {"p": fluid(fields["p"], solid), **{n: face_average(fields[n], a) for a, n in enumerate("uvw")}}.items():
        grid = grid.join(f.select(*PLACE, F.col("v").alias(name)), PLACE, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return points_lines(grid, lattice, {"pressure": F.col("p")}, {"velocity": tuple(F.col(n) for n in "uvw")})


def points_lines(grid: DataFrame, lattice: Lattice, scalars: dict[str, Column], vectors: dict[str, tuple[Column, ...]] | None = None) -> DataFrame:
    """(section, seq, value) lines of structured points: grid has idx for every point of the lattice."""
    nx, ny, nz = lattice.dims
    parts = [[*HEADER, "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", f"ORIGIN {' '.join(map(repr, lattice.low))}", f"SPACING {' '.join(map(repr, lattice.spacing))}", f"POINT_DATA {nx * ny * nz}"]]
    for name, c in scalars.items():
        parts += [[f"SCALARS {name} double", "LOOKUP_TABLE default"], grid.select(F.col("idx").alias("seq"), c.cast("string").alias("value"))]
    for name, v in (vectors or {}).items():
        parts += [[f"VECTORS {name} double"], grid.select(F.col("idx").alias("seq"), F.concat_ws(" ", *v).alias("value"))]
    return _sections(grid.sparkSession, parts)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that make up the lines in order when read by name."""
    lines.orderBy("section", "seq").select("value").write.mode("overwrite").text(path)
