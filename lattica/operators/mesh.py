"""Unstructured meshes: nodes (node_id, x, y, z) and elements (elem_id, vtk_type, nodes, marker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ids import numbered
from lattica.operators.octree import DEEPEST, Root

VOXEL, HEXAHEDRON, PIXEL, QUAD = 11, 12, 8, 9
# The corners of each face (or edge) of an element, in its own order of corners.
FACES = {
    VOXEL: ((1, 0, 3, 2), (0, 1, 4, 5), (4, 5, 6, 7), (6, 7, 2, 3), (0, 4, 2, 6), (5, 1, 7, 3)),
    HEXAHEDRON: ((1, 0, 3, 2), (0, 1, 5, 4), (4, 5, 6, 7), (7, 6, 2, 3), (0, 4, 7, 3), (5, 1, 2, 6)),
    PIXEL: ((0, 1), (1, 3), (3, 2), (2, 0)),
    QUAD: ((0, 1), (1, 2), (2, 3), (3, 0)),
}
VOXEL_TO_HEX, PIXEL_TO_QUAD = (0, 1, 3, 2, 4, 5, 7, 6), (0, 1, 3, 2)


def _pick(nodes: Column, places) -> Column:
    return F.array(*[F.get(nodes, F.lit(i)) for i in places])


def vertex_key(i: Column, j: Column, k: Column) -> Column:
    """One number for a place on the finest lattice; orders by k, then j, then i."""
    n = (1 << DEEPEST) + 1
    return (k.cast("long") * n + j) * n + i


def from_cells(cells: DataFrame, root: Root, marker: str = "nvert") -> tuple[DataFrame, DataFrame]:
    """Nodes and voxels of octree cells. Corners that cells share are one node, told apart on the finest lattice."""
    size = F.pow(F.lit(2.0), F.lit(DEEPEST) - F.col("depth")).cast("int")
    own = numbered(cells.select("depth", "i", "j", "k", F.col(marker).cast("int").alias("marker")), ["depth", "k", "j", "i"], "elem_id")
    v = own.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = [(F.col(a) + F.shiftright("v", n).bitwiseAND(F.lit(1))) * size for n, a in enumerate("ijk")]
    v = v.select("elem_id", "marker", "v", *[c.cast("int").alias(f"g{a}") for c, a in zip(at, "xyz", strict=True)]).withColumn("key", vertex_key(*[F.col(f"g{a}") for a in "xyz"]))
    unique = numbered(v.groupBy("key").agg(*[F.first(f"g{a}").alias(f"g{a}") for a in "xyz"]), ["key"], "node_id")
    n = float(1 << DEEPEST)
    nodes = unique.select("node_id", *[(F.lit(lo) + F.lit(hi - lo) * (F.col(f"g{a}") / n)).alias(a) for a, lo, hi in zip("xyz", root.low, root.high, strict=True)])
    joined = v.join(unique.select("key", "node_id"), "key")
    elements = joined.groupBy("elem_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "node_id"))), lambda s: s["node_id"]).alias("nodes"), F.first("marker").alias("marker"))
    return nodes, elements.select("elem_id", F.lit(VOXEL).alias("vtk_type"), "nodes", "marker")


def to_hexahedra(elements: DataFrame) -> DataFrame:
    return elements.select("elem_id", F.lit(HEXAHEDRON).alias("vtk_type"), _pick(F.col("nodes"), VOXEL_TO_HEX).alias("nodes"), "marker")


def to_quads(elements: DataFrame) -> DataFrame:
    return elements.select("elem_id", F.lit(QUAD).alias("vtk_type"), _pick(F.col("nodes"), PIXEL_TO_QUAD).alias("nodes"), "marker")


def faces(elements: DataFrame, vtk_type: int = VOXEL) -> DataFrame:
    """(elem_id, face, nodes) of every face, or edge of a flat element."""
    table = F.array(*[F.struct(F.lit(n).alias("face"), _pick(F.col("nodes"), f).alias("nodes")) for n, f in enumerate(FACES[vtk_type])])
    return elements.filter(F.col("vtk_type") == vtk_type).select("elem_id", F.explode(table).alias("f")).select("elem_id", "f.face", "f.nodes")


def boundary(elements: DataFrame, vtk_type: int = VOXEL) -> DataFrame:
    """Faces that one element alone has (for elements of one size)."""
    every = faces(elements, vtk_type).withColumn("key", F.sort_array("nodes"))
    once = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("elem_id", "face", "nodes")).alias("f")).filter("n = 1")
    return once.select("f.elem_id", "f.face", "f.nodes")


def node_elements(elements: DataFrame) -> DataFrame:
    """(node_id, elements) in order of elem_id; a node has as many as meet there."""
    return elements.select("elem_id", F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.sort_array(F.collect_set("elem_id")).alias("elements"))


def submesh(nodes: DataFrame, elements: DataFrame, markers: list[int]) -> tuple[DataFrame, DataFrame]:
    """The elements with these markers and their nodes, numbered anew in the old order."""
    kept = numbered(elements.filter(F.col("marker").isin(markers)).withColumnRenamed("elem_id", "old_elem"), ["old_elem"], "elem_id")
    parts = kept.select("elem_id", F.posexplode("nodes").alias("at", "old"))
    new = numbered(parts.select("old").distinct(), ["old"], "new")
    joined = parts.join(new, "old").groupBy("elem_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda s: s["new"]).alias("nodes"))
    out_nodes = nodes.join(new, nodes["node_id"] == new["old"]).select(F.col("new").alias("node_id"), "x", "y", "z")
    return out_nodes, kept.drop("nodes", "old_elem").join(joined, "elem_id").select("elem_id", "vtk_type", "nodes", "marker")


def box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[F.min(a).alias(f"l{a}") for a in "xyz"], *[F.max(a).alias(f"h{a}") for a in "xyz"])


def tracked_nodes(elements: DataFrame) -> DataFrame:
    return elements.agg(F.sum(F.size("nodes")).alias("n_tracked"))


def from_mask(mask: DataFrame, low, high, dims) -> tuple[DataFrame, DataFrame]:
    """Voxels of a mask (i, j, k, idx, marker) over a box, with shared nodes."""
    nx, ny, nz = dims
    step = [(b - a) / n for a, b, n in zip(low, high, dims, strict=True)]
    bit = lambda v, n: F.shiftright(v, n).bitwiseAND(F.lit(1))
    node = lambda v: (F.col("i") + bit(v, 0) + (nx + 1) * (F.col("j") + bit(v, 1) + (ny + 1) * (F.col("k") + bit(v, 2)))).cast("long")
    elements = mask.select(F.col("idx").alias("elem_id"), F.lit(VOXEL).alias("vtk_type"), F.array(*[node(F.lit(v)) for v in range(8)]).alias("nodes"), F.col("marker").cast("int").alias("marker"))
    n = F.col("id")
    place = (n % (nx + 1), F.floor(n / (nx + 1)) % (ny + 1), F.floor(n / ((nx + 1) * (ny + 1))))
    nodes = mask.sparkSession.range((nx + 1) * (ny + 1) * (nz + 1)).select(n.alias("node_id"), *[(F.lit(a) + F.lit(h) * p).alias(c) for a, h, p, c in zip(low, step, place, "xyz", strict=True)])
    return nodes, elements


# ---- cells whose faces may be cut in four ---------------------------------------

#: Slots of an octree cell's 26 nodes by place in its 3 x 3 x 3 lattice: eight corners (hexahedron order), twelve
#: middles of edges, six middles of faces (-x, +x, -y, +y, -z, +z).
OCT_CORNERS = ((0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (0, 0, 2), (2, 0, 2), (2, 2, 2), (0, 2, 2))
OCT_EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (3, 7), (2, 6))
OCT_FACES = ((0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2))


def oct_slots() -> dict[tuple[int, int, int], int]:
    middle = lambda a, b: tuple((x + y) // 2 for x, y in zip(OCT_CORNERS[a], OCT_CORNERS[b], strict=True))
    return {p: i for i, p in enumerate([*OCT_CORNERS, *(middle(a, b) for a, b in OCT_EDGES), *OCT_FACES])}


def oct_faces(cells: DataFrame) -> DataFrame:
    """(elem_id, face, part, nodes) of cells with nodes (26 slots) and used (26 flags): four quarters of a face
    whose middle is used (parts 1 to 4), else the face (part 0); corners in pixel order."""
    slots = oct_slots()
    rows = []
    for f, middle in enumerate(OCT_FACES):
        axis = next(i for i in range(3) if middle[i] != 1)
        others = [i for i in range(3) if i != axis]

        def at(a: int, b: int, axis=axis, others=others, middle=middle) -> int:
            p = [0, 0, 0]
            p[axis], p[others[0]], p[others[1]] = middle[axis], a, b
            return slots[tuple(p)]

        used = F.get(F.col("used"), F.lit(20 + f))
        squares = [(0, (0, 0), 2)] + [(1 + q, (q & 1, q >> 1), 1) for q in range(4)]
        for part, (a, b), w in squares:
            corners = [at(a + x, b + y) for y in (0, w) for x in (0, w)]
            rows.append(F.struct(F.lit(f).alias("face"), F.lit(part).alias("part"), _pick(F.col("nodes"), corners).alias("nodes"), (used if part else ~used).alias("there")))
    return cells.select("elem_id", F.explode(F.array(*rows)).alias("r")).filter("r.there").select("elem_id", "r.face", "r.part", "r.nodes")


def oct_node_count(cells: DataFrame) -> DataFrame:
    return cells.select("elem_id", F.size(F.filter("used", lambda u: u)).alias("n_nodes"))
