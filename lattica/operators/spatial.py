"""Spatial joins: points, lattices and cells with particles and boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import shapes
from lattica.functions.box import Box
from lattica.operators import inside
from lattica.operators.ids import settle
from lattica.sources.grids import Lattice


def bounded(particles: DataFrame) -> DataFrame:
    """particles with their tight bounding boxes (lx..hz), worked out once a particle and written: expressions that long would else be repeated wherever a bound is used."""
    return settle(shapes.prepared(particles).select("*", *shapes.library_aabb().columns()))


def bounding_box(particles: DataFrame, empty: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """One row lx..hz over all particles; the given cube without any."""
    b = bounded(particles)
    return b.agg(*[F.coalesce(F.min(f"l{a}"), F.lit(empty[0])).alias(f"l{a}") for a in "xyz"], *[F.coalesce(F.max(f"h{a}"), F.lit(empty[1])).alias(f"h{a}") for a in "xyz"])


def bucket_size(boxes: DataFrame) -> float:
    """The mean of the boxes' longest sides: most boxes then touch no more than eight buckets."""
    r = boxes.agg(F.avg(F.greatest(*[F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz"])).alias("s")).first()["s"]
    return float(r) if r and r > 0 else 1.0


def buckets_of_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each bucket a box touches, with the bucket's number bx, by, bz."""
    for a in "xyz":
        low, high = (F.floor(F.col(f"{e}{a}") / size) for e in "lh")
        boxes = boxes.withColumn(f"b{a}", F.explode(F.sequence(low, high)))
    return boxes


#: A task takes about so many points and particles of a bucket at most.
MOST_POINTS, MOST_PARTICLES = 1 << 20, 1 << 18
BUCKET = ["bx", "by", "bz"]


def _widened(boxes: DataFrame, size: float) -> DataFrame:
    wide = 1e-9 * size  # bounds are rounded; the test of the level decides
    return buckets_of_boxes(boxes.withColumns({f"{e}{a}": F.col(f"{e}{a}") + w for e, w in (("l", -wide), ("h", wide)) for a in "xyz"}), size)


def _match(points: DataFrame, particles: DataFrame, how: str) -> DataFrame:
    """Points, as a struct __pt, joined with the particles that hold them."""
    boxes = bounded(particles)
    size = bucket_size(boxes)
    near = _widened(boxes, size)
    own = points.select(F.struct("*").alias("__pt"), *[F.floor(F.col(a) / size).alias(f"__b{a}") for a in "xyz"])
    p = tuple(F.col(f"__pt.{a}") for a in "xyz")
    condition = shapes.contains(p)
    for a, c in zip("xyz", p, strict=True):
        condition = (F.col(f"__b{a}") == F.col(f"b{a}")) & c.between(F.col(f"l{a}"), F.col(f"h{a}")) & condition
    return own.join(near, condition, how)


def _dealt(own: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """own and near by bucket, and how many tasks share buckets that hold more than a task takes: np for points, nq for particles."""
    many = lambda d, most, name: d.groupBy(*BUCKET).count().filter(F.col("count") > most).select(*BUCKET, F.ceil(F.col("count") / most).cast("int").alias(name))
    more = settle(many(own, MOST_POINTS, "np").join(many(near, MOST_PARTICLES, "nq"), BUCKET, "full"))
    deal = lambda d: d.join(F.broadcast(more), BUCKET, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("np", "nq")})  # noqa: E731  # no more rows than such tasks
    return deal(own), deal(near), more


def _one(n: str) -> Column:
    return F.floor(F.rand(11) * F.col(n)).cast("int")


def _all(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _rest(points: DataFrame, particles: DataFrame, held: bool) -> DataFrame:
    """Points that some particle holds, or none; each bucket's points are held against its particles in a tree."""
    if points.isStreaming:
        return _match(points, particles, "left_semi" if held else "left_anti").select("__pt.*")
    boxes = bounded(particles)
    size = bucket_size(boxes)
    near = _widened(boxes, size).select(*BUCKET, "kind", *inside.NUMBERS)
    own = points.select(F.struct("*").alias("__pt"), *[F.floor(F.col(a) / size).alias(f"b{a}") for a in "xyz"])
    own, near, more = _dealt(own, near)
    most = more.agg(F.max("nq")).first()[0] or 1
    own, near = settle(own.select("__pt", *BUCKET, _one("np").alias("pl"), F.lit(False).alias("hit"))), near.withColumn("pass", _one("nq")).withColumn("pl", _all("np")).drop("np", "nq")
    near = settle(near) if most > 1 else near
    key, schema = [*BUCKET, "pl"], own.schema

    def test(a: pa.Table, b: pa.Table) -> pa.Table:
        hit = a["hit"].to_numpy().astype(bool)
        if a.num_rows and b.num_rows and not hit.all():
            p = np.concatenate([np.stack([at.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"], 1) for at in a["__pt"].chunks])
            open_ = ~hit & ~np.isnan(p).any(1)
            hit[open_] = inside.inside_any(p[open_], inside.particles_of(b)[1])
        return a.set_column(a.schema.get_field_index("hit"), "hit", pa.array(hit, pa.bool_()))

    for k in range(most):  # more than one only where a bucket has more particles than a task takes
        got = own.groupBy(*key).cogroup(near.filter(F.col("pass") == k).drop("pass").groupBy(*key)).applyInArrow(test, schema)
        own = settle(got) if k < most - 1 else got
    return own.filter(F.col("hit") if held else ~F.col("hit")).select("__pt.*")


def points_inside(points: DataFrame, particles: DataFrame) -> DataFrame:
    """Points (with x, y, z) in any particle."""
    return _rest(points, particles, True)


def points_outside(points: DataFrame, particles: DataFrame) -> DataFrame:
    """The complement of points_inside."""
    return _rest(points, particles, False)


def counts_inside(points: DataFrame, particles: DataFrame) -> DataFrame:
    """(particle_id, n): how many points each particle holds, without a row for each pair; particles without any are left out."""
    boxes = bounded(particles)
    size = bucket_size(boxes)
    near = _widened(boxes, size).select(*BUCKET, "particle_id", "kind", *inside.NUMBERS)
    at = points.select(*[F.col(a).cast("double").alias(a) for a in "xyz"]).dropna()
    own, near, _ = _dealt(at.select("*", *[F.floor(F.col(a) / size).alias(f"b{a}") for a in "xyz"]), near)
    own, near = own.withColumn("pl", _one("np")).withColumn("pq", _all("nq")), near.withColumn("pq", _one("nq")).withColumn("pl", _all("np"))
    key = [*BUCKET, "pl", "pq"]

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, kinds = inside.particles_of(b)
        n = np.zeros(b.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            for r, c in zip(rows, inside.count_inside(inside.coordinates(a, ("x", "y", "z")), kinds), strict=True):
                n[r] = c
        hit = pa.array(np.flatnonzero(n))
        return pa.table({"particle_id": b["particle_id"].take(hit), "n": pa.array(n).take(hit)})

    id_type = particles.schema["particle_id"].dataType.simpleString()
    got = own.drop("np", "nq").groupBy(*key).cogroup(near.drop("np", "nq").groupBy(*key)).applyInArrow(count, f"particle_id {id_type}, n long")
    return got.groupBy("particle_id").agg(F.sum("n").alias("n"))


def pairs_inside(points: DataFrame, particles: DataFrame) -> DataFrame:
    """Each point with each particle that holds it: the points' columns and particle_id."""
    return _match(points, particles, "inner").select("__pt.*", "particle_id")


def lattice_mask(particles: DataFrame, lattice: Lattice) -> DataFrame:
    """(idx, i, j, k) of the lattice's points in any particle; only those in some bounding box are tested."""
    rows = bounded(particles)
    for a, n, low, h in zip("xyz", lattice.dims, lattice.low, lattice.spacing, strict=True):
        first = F.greatest(F.ceil((F.col(f"l{a}") - low) / h) - 1, F.lit(0))
        last = F.least(F.floor((F.col(f"h{a}") - low) / h) + 1, F.lit(n - 1))
        rows = rows.filter(first <= last).withColumn(f"n{a}", F.explode(F.sequence(first, last)))
    at = tuple(F.lit(low) + F.lit(h) * F.col(f"n{a}") for a, low, h in zip("xyz", lattice.low, lattice.spacing, strict=True))
    hit = rows.filter(shapes.contains(at))
    i, j, k = (F.col(f"n{a}").cast("int") for a in "xyz")
    return hit.select(lattice.index(i, j, k).alias("idx"), i.alias("i"), j.alias("j"), k.alias("k")).distinct()


def lattice_markers(particles: DataFrame, lattice: Lattice) -> DataFrame:
    """Every point of the lattice with its marker, 1 inside any particle and else 0."""
    inside = lattice_mask(particles, lattice).select("idx", F.lit(1).alias("marker"))
    return lattice.points(particles.sparkSession).join(inside, "idx", "left").withColumn("marker", F.coalesce("marker", F.lit(0)))


def address(x: Column, low: float, high: float, depth: int) -> Column:
    """Which of 2 ** depth cells holds x; a shared face belongs to the lower one."""
    n = 1 << depth
    return F.least(F.greatest(F.ceil((x - low) / (high - low) * n) - 1, F.lit(0)), F.lit(n - 1)).cast("int")


def boxes_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, by_vertex: bool = False) -> DataFrame:
    """(left_id, right_id) of boxes (lx..hz) that overlap, by bucket; a pair is reported once, by its first common bucket."""
    size = max(bucket_size(left), bucket_size(right))
    a = buckets_of_boxes(left.select(left_id, *[f"{e}{x}" for e in "lh" for x in "xyz"]), size)
    b = buckets_of_boxes(right.select(right_id, *[F.col(f"{e}{x}").alias(f"r{e}{x}") for e in "lh" for x in "xyz"]).withColumnsRenamed({f"r{e}{x}": f"{e}{x}" for e in "lh" for x in "xyz"}), size)
    b = b.withColumnsRenamed({c: f"r_{c}" for c in b.columns if c != right_id})
    same = F.lit(True)
    for x in "xyz":
        same = same & (F.col(f"b{x}") == F.col(f"r_b{x}"))
    first = F.lit(True)
    for x in "xyz":
        first = first & (F.col(f"b{x}") == F.greatest(F.floor(F.col(f"l{x}") / size), F.floor(F.col(f"r_l{x}") / size)))
    p, q = Box.of(), Box.of("r_l", "r_h")
    test = p.intersects_by_vertex(q) if by_vertex else p.intersects(q)
    return a.join(b, same & first & p.intersects(q)).filter(test).select(left_id, right_id)
