import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.assembly import Assembly
from lattica.functions import shapes
from lattica.operators import mesh, octree, solvers, spatial, stencil
from lattica.sources import files
from lattica.sources.grids import Lattice, staggered

ROOT = octree.Root((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def particles(spark, n=30, kind="superellipsoid", seed=1):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [(i, kind, *map(float, (*rng.uniform(0.05, 0.12, 3), *rng.uniform(0.6, 1.6, 2), *rng.uniform(0.1, 0.9, 3), *q[i]))) for i in range(n)]
    return spark.createDataFrame(rows, ["particle_id", "kind", *shapes.COLUMNS])


def levels(p, pts):
    """Brute force in numpy for superellipsoids: points by particles."""
    out = []
    for _, r in p.iterrows():
        w, x, y, z = r.q0, r.q1, r.q2, r.q3
        m = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
        l = np.abs((pts - [r.x, r.y, r.z]) @ m.T) / [r.rx, r.ry, r.rz]
        out.append((l[:, 0] ** (2 / r.eps2) + l[:, 1] ** (2 / r.eps2)) ** (r.eps2 / r.eps1) + l[:, 2] ** (2 / r.eps1))
    return np.stack(out, 1)


def test_points_inside_equals_brute_force(spark):
    p = particles(spark)
    pts = np.random.default_rng(2).uniform(0, 1, (500, 3))
    df = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(pts)], ["id", "x", "y", "z"])
    want = set(np.flatnonzero((levels(p.toPandas(), pts) <= 1).any(1)).tolist())
    assert {r["id"] for r in spatial.points_inside(df, p).collect()} == want
    assert {r["id"] for r in spatial.points_outside(df, p).collect()} == set(range(500)) - want


def test_lattice_mask_equals_points(spark):
    p, g = particles(spark, 8), Lattice.over((0.0,) * 3, (1.0,) * 3, (9, 10, 11))
    pts = g.points(spark).toPandas()
    want = set(pts.idx[(levels(p.toPandas(), pts[["x", "y", "z"]].to_numpy()) <= 1).any(axis=1)])
    assert {r["idx"] for r in spatial.lattice_mask(p, g).collect()} == want


def test_bounding_box_is_tight(spark):
    p = particles(spark, 6)
    s = shapes.prepared(p)
    box = s.select(*shapes.aabb().columns()).toPandas()
    for axis, a in enumerate("xyz"):
        d = tuple(F.lit(float(i == axis)) for i in range(3))
        reach = s.select(shapes.support(d)[axis].alias("v"), shapes.level(shapes.support(d)).alias("l")).toPandas()
        assert np.allclose(reach.v, box[f"h{a}"]) and np.allclose(reach.l, 1)


@pytest.mark.parametrize("kind", ["sphere", "superellipsoid"])
def test_octree_leaves_tile_the_root_and_know_their_particles(spark, kind):
    p = particles(spark, 5, kind)
    leaves, bag = octree.refine(p, ROOT, 3)
    assert leaves.agg(F.sum(F.pow(F.lit(0.125), F.col("depth"))).alias("v")).first()["v"] == pytest.approx(1)
    pts = np.random.default_rng(3).uniform(0, 1, (400, 3))
    df = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(pts)], ["pid", "x", "y", "z"])
    at = octree.leaf_of_points(df, leaves, ROOT)
    assert at.count() == 400
    inside = spatial.pairs_inside(df, p).select("pid", "particle_id").collect()
    held = {(r["pid"], r["particle_id"]) for r in at.join(bag, octree.CELL).select("pid", "particle_id").collect()}
    assert inside and {(r["pid"], r["particle_id"]) for r in inside} <= held


def test_graded_tree_has_no_steep_neighbours(spark):
    cells = [(1, i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1) if (i, j, k) != (0, 0, 0)]
    deep = [(2, i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1) if (i, j, k) != (1, 1, 1)]
    deeper = [(3, i, j, k) for i in (2, 3) for j in (2, 3) for k in (2, 3)]
    got = {tuple(r) for r in octree.grade(spark.createDataFrame(cells + deep + deeper, "depth int, i int, j int, k int")).collect()}
    assert (1, 1, 0, 0) not in got and (2, 2, 0, 0) in got and (1, 1, 1, 1) in got


def test_uniform_mesh_counts_and_boundary(spark):
    cells = spark.createDataFrame([(2, i, j, k, 0) for i in range(4) for j in range(4) for k in range(4)], "depth int, i int, j int, k int, nvert int")
    nodes, elements = mesh.from_cells(cells, ROOT)
    assert nodes.count() == 125 and elements.count() == 64
    assert mesh.boundary(elements).count() == 96 and mesh.faces(elements).count() == 384
    sub_nodes, sub = mesh.submesh(nodes, elements, [0])
    assert sub.count() == 64 and sub_nodes.count() == 125
    assert mesh.submesh(nodes, elements, [5])[1].count() == 0


def test_oct_cell_faces(spark):
    cell = spark.createDataFrame([(0, list(range(26)), [True] * 8 + [False] * 12 + [True] + [False] * 5)], "elem_id long, nodes array<long>, used array<boolean>")
    got = mesh.oct_faces(cell).collect()
    assert len(got) == 9 and sorted(sum((r["nodes"] for r in got if r["part"]), [])).count(20) == 4
    assert mesh.oct_node_count(cell).first()["n_nodes"] == 9


def test_files_round_trip(spark, tmp_path):
    p = particles(spark, 7)
    files.write_particles(p, str(tmp_path / "p"))
    back = files.read_particles(spark, str(tmp_path / "p")).orderBy("particle_id").toPandas()
    assert np.allclose(back[shapes.COLUMNS], p.orderBy("particle_id").toPandas()[shapes.COLUMNS])
    a = Assembly(p)
    a.write_mask((3, 4, 5), str(tmp_path / "m"))
    got, dims = files.read_dat(spark, str(tmp_path / "m"))
    assert dims == (3, 4, 5)
    want = a.mask((3, 4, 5)).orderBy("idx").toPandas().marker.tolist()
    assert got.orderBy("idx").toPandas().marker.tolist() == want
    a.divide(1).write_mesh(str(tmp_path / "v"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "v").glob("part-*")))
    assert text.startswith("# vtk DataFile") and "POINTS 27 double" in text and "CELLS 8 72" in text
    a.write_points((2, 3, 4), str(tmp_path / "s"))
    assert "DIMENSIONS 2 3 4" in "".join(f.read_text() for f in sorted((tmp_path / "s").glob("part-*")))


def test_staggered_lattices():
    g = staggered((0, 0, 0), (1, 1, 1), (2, 2, 2))
    assert g["u"].dims == (3, 2, 2) and g["u"].low == (0, 0.25, 0.25) and g["p"].dims == (2, 2, 2)


def test_solvers(spark):
    from lattica.functions import linear

    a = linear.dense(spark, 6, 6, F.when(F.col("i") == F.col("j"), 4.0).otherwise(1.0))
    x = spark.range(6).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("v"))
    got = solvers.gauss_seidel(a, linear.times(a, x)).orderBy("i").toPandas().v
    assert np.allclose(got, np.arange(1, 7))
    p, v = solvers.nelder_mead(lambda t: float(((t - [1, 2, 3]) ** 2).sum()), np.vstack([np.zeros(3), np.eye(3)]), 300)
    assert v < 1e-6
    assert solvers.line_search(lambda t: (t - 0.3) ** 2, 0, 1)[0] == pytest.approx(0.3, abs=1e-6)
    assert solvers.coordinate_search(lambda t: float(((t - [0.2, 0.7]) ** 2).sum()), [0, 0], [1, 1])[1] < 1e-9


def test_laplacian_of_constant_is_zero(spark):
    f = spark.createDataFrame([(i, j, k, 2.0) for i in range(3) for j in range(3) for k in range(3)], "i int, j int, k int, v double")
    assert all(abs(r["v"]) < 1e-9 for r in stencil.laplacian(f, (3, 3, 3), (0.5, 0.5, 0.5)).collect())


def test_volume_of_unit_exponents_is_an_ellipsoid(spark):
    p = spark.createDataFrame([(0, "superellipsoid", 1.0, 2.0, 3.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], ["particle_id", "kind", *shapes.COLUMNS])
    assert p.select(shapes.volume().alias("v")).first()["v"] == pytest.approx(8 * math.pi)


def test_stream_of_points(spark, tmp_path):
    from lattica.streaming.points import inside_stream

    pts = np.random.default_rng(4).uniform(0, 1, (50, 3))
    df = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(pts)], ["pid", "x", "y", "z"])
    df.write.parquet(str(tmp_path / "in"))
    p = particles(spark)
    q = inside_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), p).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hits").count() == spatial.pairs_inside(df, p).count()


def least_level(low, high, f):
    """The least of the level's norm over each box, found on ever finer grids around the least so far; it has one valley."""
    q = f[["q0", "q1", "q2", "q3"]].to_numpy(float)
    w, x, y, z = q.T
    m = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]]).transpose(2, 0, 1)
    e1, e2 = (np.where(f["kind"] == "ellipsoid", 1.0, f[c])[:, None] for c in ("eps1", "eps2"))
    r, center = f[["rx", "ry", "rz"]].to_numpy(float)[:, None], f[["x", "y", "z"]].to_numpy(float)[:, None]
    grid = np.stack(np.meshgrid(*[np.linspace(-1, 1, 7)] * 3, indexing="ij"), -1).reshape(1, -1, 3)
    mid, half, rows, least = (low + high) / 2, (high - low) / 2, np.arange(len(f)), None
    for _ in range(28):
        p = np.clip(mid[:, None] + half[:, None] * grid, low[:, None], high[:, None])
        t = np.abs(np.einsum("nij,nkj->nki", m, p - center) / r)
        level = ((t[..., 0] ** (2 / e2) + t[..., 1] ** (2 / e2)) ** (e2 / e1) + t[..., 2] ** (2 / e1)) ** (e1 / 2)
        at = level.argmin(1)
        least, mid, half = level[rows, at], p[rows, at], half * 0.7
    return least


def test_cells_and_particles_meet_as_minimisation_says():
    """The least level over a box, found on ever finer grids (the level has one valley), against the search for a separating direction."""
    import pandas as pd

    from lattica.operators import collide

    rng = np.random.default_rng(8)
    n = 300
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    f = pd.DataFrame({"kind": np.where(np.arange(n) % 5, "superellipsoid", "ellipsoid")})
    f[["rx", "ry", "rz"]] = rng.uniform(0.3, 1.2, (n, 3))
    f[["eps1", "eps2"]] = rng.uniform(0.6, 1.7, (n, 2))
    f[["x", "y", "z"]] = rng.uniform(-1, 1, (n, 3))
    f[["q0", "q1", "q2", "q3"]] = q
    low = rng.uniform(-1.5, 1, (n, 3))
    high = low + rng.uniform(0.2, 0.8, (n, 3))
    got = collide.meet(low, high, f)
    least = least_level(low, high, f)
    clear = np.abs(least - 1) > 2e-3
    assert clear.sum() > 250 and 30 < got.sum() < n - 30
    assert (got == (least <= 1))[clear].all()


def test_superellipsoid_tree_holds_what_touches_and_nothing_else(spark):
    """Each leaf's count and corners against a test of every particle with every leaf."""
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(i, "superellipsoid", *rng.uniform(0.05, 0.15, 3).tolist(), *rng.uniform(0.7, 1.6, 2).tolist(), *rng.uniform(0.2, 0.8, 3).tolist(), 1.0, 0.0, 0.0, 0.0) for i in range(12)]
    p = spark.createDataFrame(rows, ["particle_id", "kind", *shapes.COLUMNS])
    leaves = octree.refine(p, ROOT, 3)[0].toPandas()
    every = pd.DataFrame(rows, columns=["particle_id", "kind", *shapes.COLUMNS])
    side = 0.5 ** leaves["depth"].to_numpy()[:, None]
    low = leaves[["i", "j", "k"]].to_numpy() * side
    n = len(leaves)
    pairs = pd.concat([every] * n, ignore_index=True)
    least = least_level(np.repeat(low, 12, 0), np.repeat(low + side, 12, 0), pairs).reshape(n, 12)
    surely, perhaps = (least < 1 - 2e-3).sum(1), (least < 1 + 2e-3).sum(1)
    got = leaves["n"].to_numpy()
    assert ((surely <= got) & (got <= perhaps)).all() and (surely == perhaps).mean() > 0.9 and surely.max() > 1
    corners = low[:, None] + side[:, None] * np.array([[v & 1, v >> 1 & 1, v >> 2 & 1] for v in range(8)])
    inside = levels(every, corners.reshape(-1, 3)).reshape(n, 8, 12) <= 1
    assert (leaves["nvert"].to_numpy() == inside.sum(1).max(1)).all()
    assert (side.ravel() ** 3).sum() == pytest.approx(1)


def test_relaxation_step_equals_arrays(spark):
    from lattica.operators import solvers

    dims, h, steps = (4, 3, 5), (0.5, 0.25, 0.2), 3
    rng = np.random.default_rng(1)
    solid = {n: rng.random(dims) < 0.15 for n in "uvwp"}
    start, rhs = ({n: rng.normal(size=dims) * ~solid[n] for n in "uvwp"} for _ in range(2))
    frame = lambda a, keep=None: spark.createDataFrame([(*map(int, p), float(a[p])) for p in np.ndindex(*dims) if keep is None or keep[p]], "i int, j int, k int, v double")

    def lap(name):
        return lambda f: sum((np.roll(f, 1, a) + np.roll(f, -1, a) - 2 * f) / h[a] ** 2 for a in range(3)) * ~solid[name]

    def forward(f, a, mask):
        return (f - np.roll(f, -1, a)) / h[a] * ~mask

    def mass(f):
        return sum(forward(forward(f, a, solid["uvw"[a]]), a, solid["p"]) for a in range(3))

    def cg(apply, b):
        x, r = np.zeros(dims), b.copy()
        p, rr = r, (r * r).sum()
        for _ in range(steps):
            if abs(rr) < 1e-16:
                break
            ap = apply(p)
            if (curve := (p * ap).sum()) == 0:
                break
            x, r = x + rr / curve * p, r - rr / curve * ap
            rr, before = (r * r).sum(), rr
            p = r + rr / before * p
        return x

    want = {n: a.copy() for n, a in start.items()}
    for a, n in enumerate("uvw"):
        want[n] += cg(lap(n), rhs[n] - forward(want["p"], a, solid[n]) - lap(n)(want[n]))
    e = cg(mass, rhs["p"] - sum(forward(want[n], a, solid["p"]) for a, n in enumerate("uvw")))
    for a, n in enumerate("uvw"):
        want[n] += forward(e, a, solid[n])
    want["p"] -= mass(e)
    masks = {n: frame(solid[n], solid[n]).drop("v") for n in "uvwp"}
    got = solvers.distributive_relaxation({n: frame(a) for n, a in start.items()}, {n: frame(a) for n, a in rhs.items()}, dims, h, masks, steps)
    for n, f in got.items():
        out = np.zeros(dims)
        for r in f.collect():
            out[r["i"], r["j"], r["k"]] = r["v"]
        assert np.allclose(out, want[n], rtol=1e-6, atol=1e-8), n


def test_writers_of_masks_and_staggered_grids(spark, tmp_path):
    from pyspark.sql import functions as F

    from lattica.operators import mesh, solvers
    from lattica.sources import files
    from lattica.sources.grids import Lattice

    dims = (3, 2, 4)
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, dims)
    mask = spark.createDataFrame([(*map(int, p), int(bits[p])) for p in np.ndindex(*dims)], "i int, j int, k int, marker int")
    for first in (False, True):
        files.write_dat(mask.repartition(5), dims, str(tmp_path / f"m{first}"), blank_first=first)
        got, size = files.read_dat(spark, str(tmp_path / f"m{first}"))
        assert size == dims and all(bits[r["i"], r["j"], r["k"]] == r["marker"] for r in got.collect()) and got.count() == 24
    files.dat_to_vtk(spark, str(tmp_path / "mTrue"), (0.0,) * 3, (1.0,) * 3, str(tmp_path / "vtk"))
    text = "\n".join(r["value"] for r in files.lines_of(spark, str(tmp_path / "vtk")).orderBy(*files.LINE).collect())
    assert "POINTS 60 double" in text and "CELLS 24 216" in text and "SCALARS centroid int" in text
    assert text.split("LOOKUP_TABLE default\n")[1].split() == [str(b) for b in bits.transpose(2, 1, 0).ravel()]
    nodes, elements = mesh.from_mask(spark.createDataFrame([(0, 0, 0, 0, 1)], "i int, j int, k int, idx long, marker int"), (0.0,) * 3, (1.0,) * 3, (1, 1, 1))
    lines = [r["value"] for r in files.mesh_lines(nodes.withColumn("m", F.col("node_id") % 2), elements, node_marker="m").orderBy("section", "seq").collect()]
    at = lines.index("POINT_DATA 8")
    assert lines[at + 1 : at + 3] == ["SCALARS nodeMarkers int", "LOOKUP_TABLE default"] and lines[at + 3 :] == [str(i % 2) for i in range(8)]
    edges = mesh.faces(mesh.to_quads(spark.createDataFrame([(7, 8, [1, 2, 3, 4], 0)], "elem_id long, vtk_type int, nodes array<long>, marker int")), mesh.QUAD).orderBy("face").collect()
    assert [r["nodes"] for r in edges] == [[1, 2], [2, 4], [4, 3], [3, 1]]

    def field(shape, f):
        return spark.createDataFrame([(*map(int, p), float(f(*p))) for p in np.ndindex(*shape)], "i int, j int, k int, v double")

    fields = {"u": field((3, 2, 2), lambda i, j, k: i), "v": field((2, 3, 2), lambda i, j, k: 10 * j), "w": field((2, 2, 3), lambda i, j, k: 100 * k), "p": field((2, 2, 2), lambda i, j, k: i + 2 * j + 4 * k)}
    solid = spark.createDataFrame([(1, 1, 1)], "i int, j int, k int")
    lines = [r["value"] for r in files.staggered_lines(fields, Lattice.over((0.0,) * 3, (1.0,) * 3, (2, 2, 2)), solid).orderBy("section", "seq").collect()]
    at = lines.index("SCALARS pressure double")
    assert [float(x) for x in lines[at + 2 : at + 10]] == [0, 1, 2, 3, 4, 5, 6, 0]
    assert [tuple(map(float, x.split())) for x in lines[-8:]] == [(i + 0.5, 10 * (j + 0.5), 100 * (k + 0.5)) for k in range(2) for j in range(2) for i in range(2)]
    with pytest.raises(ValueError):
        solvers.gauss_seidel(spark.createDataFrame([(5000, 0, 1.0)], "i int, j int, v double"), spark.createDataFrame([(0, 1.0)], "i int, v double"))


def test_boxes_that_touch_overlap(spark):
    """A superellipsoid whose bound is exactly 0.116, by the C library's powers, beside a sphere that ends there."""
    rows = [
        (3380, "sphere", 0.036, 0.04, 0.052000000000000005, 1.4, 1.2, 0.08, 0.38, 0.21782178217821782, 0.408248290463863, 0.0, 0.816496580927726, 0.408248290463863),
        (5359, "superellipsoid", 0.034, 0.044, 0.051000000000000004, 1.19, 0.73, 0.16, 0.35899999999999976, 0.19801980198019803, 0.31622776601683794, 0.6324555320336759, 0.6324555320336759, 0.31622776601683794),
        (1, None, 0.034, 0.044, 0.05, 1.19, 0.73, 5.0, 5.0, None, 1.0, 0.0, 0.0, 0.0),
    ]
    schema = "particle_id long, kind string, " + ", ".join(f"{c} double" for c in shapes.COLUMNS)
    b = spatial.bounded(spark.createDataFrame(rows, schema))
    assert {r["particle_id"]: (r["lx"], r["hx"]) for r in b.collect() if r["kind"]} == {3380: (0.044000000000000004, 0.11599999999999999), 5359: (0.11599999999999999, 0.20400000000000001)}
    got = spatial.boxes_overlap(b, b.withColumnRenamed("particle_id", "other"), "particle_id", "other").collect()
    assert sorted(tuple(r) for r in got) == [(3380, 3380), (3380, 5359), (5359, 3380), (5359, 5359)]


@pytest.mark.parametrize("by_vertex", [False, True])
def test_overlaps_are_counted_as_pairs_are(spark, monkeypatch, by_vertex):
    """Boxes of very different sizes, many that touch, copies, flat ones, and cells dealt to several tasks, with no join of pairs."""
    from lattica.operators import overlap

    rng = np.random.default_rng(3)
    low = np.round(rng.uniform(-1, 1, (400, 3)), 1)
    side = np.round(rng.choice([0.0, 0.1, 0.3, 1.5], (400, 3)), 1)
    low[300:340], side[300:340] = low[0], side[0]
    high = low + side
    rows = [(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    b = spark.createDataFrame([*rows, (400, None, 0.0, 0.0, 1.0, 1.0, 1.0)], "id long, lx double, ly double, lz double, hx double, hy double, hz double")
    monkeypatch.setattr(overlap, "MOST_COUNTED", 50)
    monkeypatch.setattr(overlap, "MOST_ASKING", 60)
    one = lambda x: x[:, None, :]
    hit = ((one(low) <= high) & (low <= one(high))).all(2)
    if by_vertex:
        corners = [(np.where([n >> a & 1 for a in range(3)], high, low)) for n in range(8)]
        inside = lambda c: ((one(low) <= c) & (c <= one(high))).all(2)
        hit &= np.any([m for c in corners for m in (inside(c), inside(c).T)], axis=0)
    plan = overlap.overlap_counts(b, b, "id", by_vertex)
    assert {r["id"]: r["n"] for r in plan.collect()} == dict(enumerate(hit.sum(1).tolist()))
    assert overlap.count_overlaps(np.repeat(low, 3, 0), np.repeat(high, 3, 0), np.repeat(low, 20, 0), np.repeat(high, 20, 0), by_vertex).tolist() == np.repeat(20 * hit.sum(1), 3).tolist()
    none = b.limit(0)
    assert overlap.overlap_counts(none, b, "id", by_vertex).count() == overlap.overlap_counts(b, none, "id", by_vertex).count() == 0


def test_queries_of_overlaps_make_no_pairs(spark, monkeypatch):
    from lattica.plans import catalog

    monkeypatch.setattr(spatial, "boxes_overlap", None)
    boxes = spatial.bounded(particles(spark, 20))
    monkeypatch.setattr(catalog, "boxes", lambda *_: boxes)
    assert catalog.QUERIES["box_intersects"](spark, "").count() == catalog.QUERIES["box_intersects_vertex"](spark, "").count() == 20


def _crowd(spark):
    """Points on lines, copies of points and particles, null coordinates, and particles of all kinds."""
    rng = np.random.default_rng(8)
    p = particles(spark, 24).withColumn("kind", F.element_at(F.array(*map(F.lit, ("sphere", "prism", "ellipsoid", "superellipsoid"))), (F.col("particle_id") % 4 + 1).cast("int")))
    p = p.unionByName(p.filter("particle_id < 6").withColumn("particle_id", F.col("particle_id") + 100))
    at = np.stack([rng.integers(0, 11, 900) / 10, rng.uniform(0, 1, 900), rng.integers(0, 11, 900) / 10], 1)
    at[600:] = at[300:600]
    rows = [(i, *map(float, r)) for i, r in enumerate(at)] + [(900, None, 0.5, 0.5), (901, 50.0, 50.0, -50.0)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double"), p


def test_counts_and_masks_make_no_pairs(spark, monkeypatch):
    """Trees of points, with buckets dealt to several tasks and passes, hold what the join of pairs does."""
    df, p = _crowd(spark)
    pairs = spatial.pairs_inside(df.select("id", "x", "y", "z"), p).select("id", "particle_id").collect()
    counts = {}
    for r in pairs:
        counts[r["particle_id"]] = counts.get(r["particle_id"], 0) + 1
    held = {r["id"] for r in pairs}
    assert len(held) > 50 and len(counts) > 15
    monkeypatch.setattr(spatial, "_match", None)
    for points, some in ((1 << 20, 1 << 18), (40, 5)):
        monkeypatch.setattr(spatial, "MOST_POINTS", points)
        monkeypatch.setattr(spatial, "MOST_PARTICLES", some)
        assert {r["particle_id"]: r["n"] for r in spatial.counts_inside(df, p).collect()} == counts
        assert sorted(r["id"] for r in spatial.points_inside(df, p).collect()) == sorted(held)
        assert sorted(r["id"] for r in spatial.points_outside(df, p).collect()) == sorted(set(range(902)) - held)
    assert spatial.points_outside(df, p.limit(0)).count() == 902 and spatial.counts_inside(df.limit(0), p).count() == 0


def test_boxes_that_plainly_meet_need_no_search(monkeypatch):
    import pandas as pd

    from lattica.operators import collide

    kinds = ["sphere", "prism", "ellipsoid", "superellipsoid"]
    f = pd.DataFrame({"kind": kinds, **{c: [v] * 4 for c, v in zip(shapes.COLUMNS, (1.0, 1.0, 1.0, 1.2, 0.8, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), strict=True)}})
    low, high = np.full((4, 3), 0.2), np.full((4, 3), 3.0)
    apart = collide.meet(low + 5, high + 5, f)
    monkeypatch.setattr(collide, "particle_support", None)
    monkeypatch.setattr(collide, "MOST_STEPS", 0)
    assert not apart.any() and collide.holds(np.full((4, 3), 0.2), f["kind"].to_numpy(), np.ones((4, 3)), np.ones((4, 2)), np.zeros((4, 3)), np.tile(np.eye(3), (4, 1, 1))).all()
    monkeypatch.setattr(collide, "MOST_STEPS", 1)
    monkeypatch.setattr(collide, "particle_support", lambda d, *_: np.zeros_like(d) if not len(d) else pytest.fail("searched"))
    assert collide.meet(low, high, f).all()
