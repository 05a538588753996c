"""Registry of queries over the driver's tables and their SQL counterparts.

Points are rows of lineitem, particles rows of part, boxes lie around particles,
vectors are embeddings; both sides make them by the same arithmetic. Doubles are
rounded to six places so that the last bits of library functions don't count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import linear, quat, shapes, vec
from lattica.functions.box import Box
from lattica.operators import mesh, octree, overlap, solvers, spatial, stencil
from lattica.sources import files
from lattica.sources.grids import Lattice

QUERIES: dict = {}
ORACLE_SQL: dict = {}
PLACES = 6
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def rnd(c: Column) -> Column:
    return F.round(c.cast("double"), PLACES)


def r(sql: str) -> str:
    return f"(round(({sql})::DOUBLE, {PLACES}) + 0.0)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- adapters ---------------------------------------------------------------------

PTS = f"pts AS (SELECT {KEYS}, l_quantity / 50.0 AS x, (l_extendedprice % 1000.0) / 1000.0 AS y, l_tax * 12.5 AS z FROM lineitem)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEY, (F.col("l_quantity") / 50.0).alias("x"), ((F.col("l_extendedprice") % 1000.0) / 1000.0).alias("y"), (F.col("l_tax") * 12.5).alias("z"))


KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'sphere' WHEN 1 THEN 'prism' WHEN 2 THEN 'ellipsoid' ELSE 'superellipsoid' END"
PRT = f"""raw AS (SELECT p_partkey AS particle_id, {{kind}} AS kind, 0.03::DOUBLE + 0.001::DOUBLE * (p_partkey % 7) AS rx, 0.04::DOUBLE + 0.001::DOUBLE * (p_partkey % 5) AS ry, 0.05::DOUBLE + 0.001::DOUBLE * (p_partkey % 3) AS rz,
 0.6::DOUBLE + 0.01::DOUBLE * (p_partkey % 100) AS eps1, 0.6::DOUBLE + 0.01::DOUBLE * ((p_partkey * 7) % 100) AS eps2, p_size / 50.0::DOUBLE AS x, (p_retailprice - 900) / 100.0::DOUBLE AS y, ((p_partkey * 37) % 101) / 101.0::DOUBLE AS z,
 (1 + p_partkey % 3)::DOUBLE AS a0, (p_partkey % 5)::DOUBLE AS a1, (p_partkey % 7)::DOUBLE AS a2, (p_partkey % 11)::DOUBLE AS a3 FROM part),
unit AS (SELECT *, sqrt(a0*a0 + a1*a1 + a2*a2 + a3*a3) AS n FROM raw),
pq AS (SELECT particle_id, kind, rx::DOUBLE AS rx, ry::DOUBLE AS ry, rz::DOUBLE AS rz, eps1::DOUBLE AS eps1, eps2::DOUBLE AS eps2, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, a0/n AS q0, a1/n AS q1, a2/n AS q2, a3/n AS q3 FROM unit),
prt AS (SELECT *, q0*q0+q1*q1-q2*q2-q3*q3 AS m00, 2*(q1*q2-q0*q3) AS m01, 2*(q1*q3+q0*q2) AS m02, 2*(q1*q2+q0*q3) AS m10, q0*q0-q1*q1+q2*q2-q3*q3 AS m11, 2*(q2*q3-q0*q1) AS m12,
 2*(q1*q3-q0*q2) AS m20, 2*(q2*q3+q0*q1) AS m21, q0*q0-q1*q1-q2*q2+q3*q3 AS m22 FROM pq)"""
MIXED, SUPER, SPHERES = PRT.format(kind=KINDS), PRT.format(kind="'superellipsoid'"), PRT.format(kind="'sphere'")


def particles(spark: SparkSession, d: str, kind: str = "mixed") -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("sphere", "prism", "ellipsoid", "superellipsoid"))), (k % 4 + 1).cast("int")) if kind == "mixed" else F.lit(kind)
    q = [(1 + k % 3).cast("double"), (k % 5).cast("double"), (k % 7).cast("double"), (k % 11).cast("double")]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    raw = table(spark, d, "part").select(
        k.alias("particle_id"), name.alias("kind"), (0.03 + 0.001 * (k % 7)).alias("rx"), (0.04 + 0.001 * (k % 5)).alias("ry"), (0.05 + 0.001 * (k % 3)).alias("rz"),
        (0.6 + 0.01 * (k % 100)).alias("eps1"), (0.6 + 0.01 * ((k * 7) % 100)).alias("eps2"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") - 900) / 100.0).alias("y"),
        (((k * 37) % 101) / 101.0).alias("z"), *[(c / n).alias(f"q{i}") for i, c in enumerate(q)],
    )
    return shapes.prepared(raw)


def local_sql(x: str, y: str, z: str, p: str = "p") -> list[str]:
    d = [f"({x} - {p}.x)", f"({y} - {p}.y)", f"({z} - {p}.z)"]
    return [" + ".join(f"{p}.m{i}{j} * {d[j]}" for j in range(3)) for i in range(3)]


def level_sql(x: str, y: str, z: str, p: str = "p") -> str:
    a, b, c = (f"({e})" for e in local_sql(x, y, z, p))
    sup = f"pow(pow(pow({a}/{p}.rx,2),1/{p}.eps2) + pow(pow({b}/{p}.ry,2),1/{p}.eps2), {p}.eps2/{p}.eps1) + pow(pow({c}/{p}.rz,2),1/{p}.eps1)"
    return f"""CASE {p}.kind WHEN 'sphere' THEN ({a}*{a}+{b}*{b}+{c}*{c})/({p}.rx*{p}.rx) WHEN 'prism' THEN greatest(abs({a}/{p}.rx), abs({b}/{p}.ry), abs({c}/{p}.rz))
 WHEN 'ellipsoid' THEN sqrt(({a}/{p}.rx)*({a}/{p}.rx)+({b}/{p}.ry)*({b}/{p}.ry)+({c}/{p}.rz)*({c}/{p}.rz)) ELSE {sup} END"""


def reach_sql(x: str, y: str, z: str) -> str:
    u, v, w = f"abs(({x})*rx)", f"abs(({y})*ry)", f"abs(({z})*rz)"
    p, q = "(2/(2-eps2))", "(2/(2-eps1))"
    return f"CASE kind WHEN 'sphere' THEN rx*sqrt(({x})*({x})+({y})*({y})+({z})*({z})) WHEN 'prism' THEN {u}+{v}+{w} WHEN 'ellipsoid' THEN sqrt({u}*{u}+{v}*{v}+{w}*{w}) ELSE pow(pow(pow(pow({u},{p})+pow({v},{p}),1/{p}),{q})+pow({w},{q}),1/{q}) END"


AABB = "box AS (SELECT *, " + ", ".join(f"{a} {s} ({reach_sql(f'm0{j}', f'm1{j}', f'm2{j}')}) AS {e}{a}" for j, a in enumerate("xyz") for e, s in (("l", "-"), ("h", "+"))) + " FROM prt)"
#: No particle reaches further than this from its centre; lets the brute force skip what can't be inside.
FAR = 0.11
NEAR = " AND ".join(f"t.{a} BETWEEN p.{a} - {FAR} AND p.{a} + {FAR}" for a in "xyz")

# ---- vectors ------------------------------------------------------------------------

EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS b FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", v.alias("a"), F.reverse(v).alias("b"))


def rounded(c: Column) -> Column:
    return F.transform(c, rnd)


def rl(sql: str) -> str:
    return f"list_transform({sql}, lambda x: {r('x')})"


def zipped(expr: str) -> str:
    return f"list_transform(list_zip(a, b), lambda t: {expr})"


def _vector(name: str, sparks: Callable[[Column, Column], dict[str, Column]], sqls: dict[str, str]) -> None:
    sql = f"WITH {EMB} SELECT vec_id, {', '.join(f'{s} AS {n}' for n, s in sqls.items())} FROM e"
    query(name, sql)(lambda spark, d: vectors(spark, d).select("vec_id", *[c.alias(n) for n, c in sparks(F.col("a"), F.col("b")).items()]))


SUM = "list_sum"
_vector("vec_add", lambda A, B: {"v": rounded(vec.add(A, B))}, {"v": rl(zipped("t[1] + t[2]"))})
_vector("vec_sub", lambda A, B: {"v": rounded(vec.sub(A, B))}, {"v": rl(zipped("t[1] - t[2]"))})
_vector("vec_mul", lambda A, B: {"v": rounded(vec.mul(A, B))}, {"v": rl(zipped("t[1] * t[2]"))})
_vector("vec_div", lambda A, B: {"v": F.transform(vec.div(A, B), lambda x: F.round(x, 4))}, {"v": f"list_transform({zipped('t[1] / nullif(t[2], 0)')}, lambda x: round(x, 4) + 0.0)"})
_vector("vec_scale_neg", lambda A, B: {"s": rounded(vec.scale(A, 2.5)), "n": rounded(vec.neg(A))}, {"s": rl("list_transform(a, lambda x: x * 2.5)"), "n": rl("list_transform(a, lambda x: -x)")})
_vector("vec_dot", lambda A, B: {"dot": rnd(vec.dot(A, B)), "total": rnd(vec.total(A))}, {"dot": r(f"{SUM}({zipped('t[1] * t[2]')})"), "total": r("list_sum(a)")})
_vector("vec_norms", lambda A, B: {"n2": rnd(vec.norm2(A)), "n": rnd(vec.norm(A)), "inf": rnd(vec.infnorm(A))}, {"n2": r("list_sum(list_transform(a, lambda x: x*x))"), "n": r("sqrt(list_sum(list_transform(a, lambda x: x*x)))"), "inf": r("list_max(list_transform(a, lambda x: abs(x)))")})
_vector("vec_dist", lambda A, B: {"d2": rnd(vec.dist2(A, B)), "d": rnd(vec.dist(A, B)), "inf": rnd(vec.dist_inf(A, B))}, {"d2": r(f"list_sum({zipped('(t[1]-t[2])*(t[1]-t[2])')})"), "d": r(f"sqrt(list_sum({zipped('(t[1]-t[2])*(t[1]-t[2])')}))"), "inf": r(f"list_max({zipped('abs(t[1]-t[2])')})")})
_vector("vec_minmax_idx", lambda A, B: {"hi": rnd(F.array_max(A)), "lo": rnd(F.array_min(A)), "at_hi": vec.argmax(A), "at_lo": vec.argmin(A), "len": F.size(A)}, {"hi": r("list_max(a)"), "lo": r("list_min(a)"), "at_hi": "(list_position(a, list_max(a)) - 1)::INTEGER", "at_lo": "(list_position(a, list_min(a)) - 1)::INTEGER", "len": "len(a)::INTEGER"})
_vector("vec_normalize", lambda A, B: {"v": rounded(vec.normalize(A))}, {"v": rl("list_transform(a, lambda x: x / sqrt(list_sum(list_transform(a, lambda y: y*y))))")})
_vector("vec_cross", lambda A, B: {"v": rounded(vec.cross(A, B))}, {"v": rl("[a[2]*b[3]-a[3]*b[2], a[3]*b[1]-a[1]*b[3], a[1]*b[2]-a[2]*b[1]]")})
_vector("vec_elminmax", lambda A, B: {"lo": rounded(vec.el_min(A, B)), "hi": rounded(vec.el_max(A, B))}, {"lo": rl(zipped("least(t[1], t[2])")), "hi": rl(zipped("greatest(t[1], t[2])"))})
_vector("vec_cone_cmp", lambda A, B: {"below": vec.lt(A, vec.add(A, vec.fill(1, 64))), "less": vec.lt(F.slice(A, 1, 3), F.slice(B, 1, 3)), "at_least": vec.ge(F.slice(A, 1, 2), F.slice(B, 1, 2)), "same": vec.eq(A, B)}, {"below": "true", "less": "a[1]<b[1] AND a[2]<b[2] AND a[3]<b[3]", "at_least": "a[1]>=b[1] AND a[2]>=b[2]", "same": "a = b"})

# ---- quaternions -------------------------------------------------------------------------


def four(name: str, q) -> list[Column]:
    return [rnd(c).alias(f"{name}{i}") for i, c in enumerate(q)]


def _second() -> tuple:
    return tuple(c.cast("double") for c in (F.col("rx") * 10, F.col("ry") * 10, F.col("rz") * 10, F.lit(0.5)))


HAM = {0: "q0*b0-q1*b1-q2*b2-q3*b3", 1: "q0*b1+q1*b0+q2*b3-q3*b2", 2: "q0*b2-q1*b3+q2*b0+q3*b1", 3: "q0*b3+q1*b2-q2*b1+q3*b0"}
QB = "qb AS (SELECT *, rx*10 AS b0, ry*10 AS b1, rz*10 AS b2, 0.5::DOUBLE AS b3 FROM prt)"


@query("quat_mul", f"WITH {MIXED}, {QB} SELECT particle_id, {', '.join(f'{r(s)} AS m{i}' for i, s in HAM.items())} FROM qb")
def _(spark, d):
    return particles(spark, d).select("particle_id", *four("m", quat.mul(quat.of(), _second())))


@query("quat_add_sub", f"WITH {MIXED}, {QB} SELECT particle_id, {', '.join(f'{r(f'q{i}+b{i}')} AS s{i}, {r(f'q{i}-b{i}')} AS d{i}' for i in range(4))} FROM qb")
def _(spark, d):
    return particles(spark, d).select("particle_id", *four("s", quat.add(quat.of(), _second())), *four("d", quat.sub(quat.of(), _second())))


@query("quat_inv", f"WITH {MIXED}, {QB}, n AS (SELECT *, b0*b0+b1*b1+b2*b2+b3*b3 AS n2 FROM qb) SELECT particle_id, {r('b0/n2')} AS i0, {r('-b1/n2')} AS i1, {r('-b2/n2')} AS i2, {r('-b3/n2')} AS i3, {r('n2')} AS n2, {r('sqrt(n2)')} AS n, {r('b0/sqrt(n2)')} AS u0 FROM n")
def _(spark, d):
    b = _second()
    return particles(spark, d).select("particle_id", *four("i", quat.inv(b)), rnd(quat.norm2(b)).alias("n2"), rnd(quat.norm(b)).alias("n"), rnd(quat.normalize(b)[0]).alias("u0"))


@query("quat_div", f"WITH {MIXED}, {QB}, c AS (SELECT q0, q1, q2, q3, particle_id, b0/n2 AS b0, -b1/n2 AS b1, -b2/n2 AS b2, -b3/n2 AS b3 FROM (SELECT *, b0*b0+b1*b1+b2*b2+b3*b3 AS n2 FROM qb)) SELECT particle_id, {', '.join(f'{r(s)} AS m{i}' for i, s in HAM.items())} FROM c")
def _(spark, d):
    return particles(spark, d).select("particle_id", *four("m", quat.div(quat.of(), _second())))


@query("quat_rotate", f"WITH {MIXED} SELECT particle_id, {', '.join(f'{r(f'm{i}0*x + m{i}1*y + m{i}2*z')} AS v{i}' for i in range(3))} FROM prt")
def _(spark, d):
    return particles(spark, d).select("particle_id", *four("v", quat.rotate(quat.of(), (F.col("x"), F.col("y"), F.col("z")))))


@query("quat_angle_axis", f"WITH {MIXED} SELECT particle_id, {r('2*acos(q0)')} AS angle, {', '.join(f'{r(f'q{i}/nullif(sqrt(q1*q1+q2*q2+q3*q3),0)')} AS a{i - 1}' for i in (1, 2, 3))} FROM prt")
def _(spark, d):
    return particles(spark, d).select("particle_id", rnd(quat.angle(quat.of())).alias("angle"), *four("a", quat.axis(quat.of())))


@query("quat_from_axis_angle", f"WITH {MIXED} SELECT particle_id, {r('cos(x*3/2)')} AS q0, {', '.join(f'{r(f'sin(x*3/2)*{c}/sqrt(rx*rx+ry*ry+rz*rz)')} AS q{i}' for i, c in ((1, 'rx'), (2, 'ry'), (3, 'rz')))} FROM prt")
def _(spark, d):
    return particles(spark, d).select("particle_id", *four("q", quat.from_axis_angle(F.col("x") * 3, (F.col("rx"), F.col("ry"), F.col("rz")))))


# ---- boxes -------------------------------------------------------------------------------


def boxes(spark: SparkSession, d: str, kind: str = "mixed") -> DataFrame:
    return spatial.bounded(particles(spark, d, kind))


def six(b: Box, low: str = "l", high: str = "h") -> list[Column]:
    return [rnd(c).alias(f"{e}{a}") for e, v in ((low, b.low), (high, b.high)) for a, c in zip("xyz", v, strict=True)]


SIX = ", ".join(f"{r(f'{e}{a}')} AS {e}{a}" for e in "lh" for a in "xyz")


@query("particle_aabb", f"WITH {MIXED}, {AABB} SELECT particle_id, {SIX} FROM box")
def _(spark, d):
    return boxes(spark, d).select("particle_id", *six(Box.of()))


@query("assembly_bbox", f"WITH {MIXED}, {AABB} SELECT {', '.join(f'{r(f'{f}({e}{a})')} AS {e}{a}' for e, f in (('l', 'min'), ('h', 'max')) for a in 'xyz')} FROM box")
def _(spark, d):
    return spatial.bounding_box(particles(spark, d)).select(*six(Box.of()))


@query("box_measures", f"WITH {MIXED}, {AABB} SELECT particle_id, {r('(lx+hx)/2')} AS cx, {r('hy-ly')} AS sy, {r('(hx-lx)*(hy-ly)*(hz-lz)')} AS volume, {r('sqrt((hx-lx)*(hx-lx)+(hy-ly)*(hy-ly)+(hz-lz)*(hz-lz))')} AS diam, true AS valid FROM box")
def _(spark, d):
    b = Box.of()
    return boxes(spark, d).select("particle_id", rnd(b.center[0]).alias("cx"), rnd(b.side[1]).alias("sy"), rnd(b.volume).alias("volume"), rnd(b.diam).alias("diam"), b.valid.alias("valid"))


@query("box_vertices", f"WITH {MIXED}, {AABB} SELECT particle_id, n::INTEGER AS n, {', '.join(f'{r(f'CASE WHEN (n >> {i}) & 1 = 1 THEN h{a} ELSE l{a} END')} AS {a}' for i, a in enumerate('xyz'))}, {r('CASE WHEN n % 4 IN (1, 2) THEN hx ELSE lx END')} AS hex_x FROM box, generate_series(0, 7) g(n)")
def _(spark, d):
    v = boxes(spark, d).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    b = Box.of()
    return v.select("particle_id", "n", *[rnd(c).alias(a) for a, c in zip("xyz", b.vertex(F.col("n")), strict=True)], rnd(b.hexvertex(F.col("n"))[0]).alias("hex_x"))


@query("box_faces", f"WITH {MIXED}, {AABB} SELECT particle_id, n::INTEGER AS n, {', '.join(f'{r(f'CASE n WHEN {i} THEN l{a} WHEN {i + 3} THEN h{a} ELSE (l{a}+h{a})/2 END')} AS {a}, (CASE n WHEN {i} THEN -1.0 WHEN {i + 3} THEN 1.0 ELSE 0.0 END)::DOUBLE AS n{a}' for i, a in enumerate('xyz'))} FROM box, generate_series(0, 5) g(n)")
def _(spark, d):
    v = boxes(spark, d).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5))))
    b = Box.of()
    return v.select("particle_id", "n", *[rnd(c).alias(a) for a, c in zip("xyz", b.face_center(F.col("n")), strict=True)], *[c.cast("double").alias(f"n{a}") for a, c in zip("xyz", b.face_normal(F.col("n")), strict=True)])


@query("box_scale_shift", f"WITH {MIXED}, {AABB} SELECT particle_id, {', '.join(f'{r(f'(l{a}+h{a})/2 + x - (h{a}-l{a})*0.75')} AS l{a}, {r(f'(l{a}+h{a})/2 + x + (h{a}-l{a})*0.75')} AS h{a}' for a in 'xyz')} FROM box")
def _(spark, d):
    return boxes(spark, d).select("particle_id", *six(Box.of().scale(1.5).shift((F.col("x"),) * 3)))


@query("box_set_corner", f"WITH {MIXED}, {AABB} SELECT particle_id, {', '.join(f'{r(f'least(0.5, h{a})')} AS l{a}, {r(f'greatest(0.5, h{a})')} AS h{a}' for a in 'xyz')} FROM box")
def _(spark, d):
    return boxes(spark, d).select("particle_id", *six(Box.of().with_low((F.lit(0.5),) * 3)))


@query("box_combine", f"WITH {MIXED}, {AABB} SELECT particle_id, {', '.join(f'{r(f'least(l{a}, 0.25)')} AS l{a}, {r(f'greatest(h{a}, 0.75)')} AS h{a}' for a in 'xyz')} FROM box")
def _(spark, d):
    return boxes(spark, d).select("particle_id", *six(Box.of().combine(Box.from_points((F.lit(0.75),) * 3, (F.lit(0.25),) * 3))))


@query("box_contains", f"WITH {PTS} SELECT {KEYS}, x>=0.2 AND x<=0.8 AND y>=0.2 AND y<=0.8 AND z>=0.2 AND z<=0.8 AS closed, x>0.2 AND x<0.8 AND y>0.2 AND y<0.8 AND z>0.2 AND z<0.8 AS strict FROM pts")
def _(spark, d):
    b, p = Box((F.lit(0.2),) * 3, (F.lit(0.8),) * 3), (F.col("x"), F.col("y"), F.col("z"))
    return points(spark, d).select(*KEY, b.contains(p).alias("closed"), b.contains_strictly(p).alias("strict"))


OVERLAP = " AND ".join(f"a.l{c} <= b.h{c} AND b.l{c} <= a.h{c}" for c in "xyz")
CORNER = " OR ".join("(" + " AND ".join(f"{p}.{'h' if n >> i & 1 else 'l'}{c} BETWEEN {q}.l{c} AND {q}.h{c}" for i, c in enumerate("xyz")) + ")" for p, q in (("a", "b"), ("b", "a")) for n in range(8))
PAIRS = f"WITH {MIXED}, {AABB} SELECT a.particle_id, count(*) AS n FROM box a, box b WHERE {OVERLAP}"


@query("box_intersects", f"{PAIRS} GROUP BY 1")
def _(spark, d):
    b = boxes(spark, d)
    return overlap.overlap_counts(b, b, "particle_id")


@query("box_intersects_vertex", f"{PAIRS} AND ({CORNER}) GROUP BY 1")
def _(spark, d):
    b = boxes(spark, d)
    return overlap.overlap_counts(b, b, "particle_id", by_vertex=True)


# ---- planes and matrices ---------------------------------------------------------------------


@query("plane_dist", f"WITH {PTS} SELECT {KEYS}, {r('((x-0.5)*1 + (y-0.5)*2 + (z-0.5)*2)/3')} AS dist, {', '.join(f'{r(f'{c} - ((x-0.5)*1 + (y-0.5)*2 + (z-0.5)*2)/3*{n}/3')} AS p{c}' for c, n in zip('xyz', (1, 2, 2), strict=True))} FROM pts")
def _(spark, d):
    plane = linear.Plane.of((F.lit(0.5),) * 3, (F.lit(1.0), F.lit(2.0), F.lit(2.0)))
    p = (F.col("x"), F.col("y"), F.col("z"))
    return points(spark, d).select(*KEY, rnd(plane.distance(p)).alias("dist"), *[rnd(c).alias(f"p{a}") for a, c in zip("xyz", plane.project(p), strict=True)])


S8 = f"{math.sqrt(8)!r}"
LOCAL = (f"(2*(y-0.5) - 2*(z-0.5))/{S8}", f"(-8*(x-0.5) + 2*(y-0.5) + 2*(z-0.5))/(3*{S8})")


@query("plane_local", f"WITH {PTS} SELECT {KEYS}, {r(LOCAL[0])} AS u, {r(LOCAL[1])} AS v, true AS back FROM pts")
def _(spark, d):
    plane = linear.Plane.of((F.lit(0.5),) * 3, (F.lit(1.0), F.lit(2.0), F.lit(2.0)))
    p = (F.col("x"), F.col("y"), F.col("z"))
    q = plane.to_local(p)
    g = plane.to_global(q)
    back = F.lit(True)
    for a, b in zip(p, g, strict=True):
        back = back & (F.abs(a - b) < 1e-9)
    return points(spark, d).select(*KEY, rnd(q[0]).alias("u"), rnd(q[1]).alias("v"), back.alias("back"))


DET = "m00*(m11*m22-m12*m21)-m01*(m10*m22-m12*m20)+m02*(m10*m21-m11*m20)"


@query("mat3_det_inv_solve", f"WITH {MIXED} SELECT particle_id, {r(DET)} AS det, {r('m00+m11+m22')} AS trace, {', '.join(f'{r(f'm0{i}*x+m1{i}*y+m2{i}*z')} AS s{i}' for i in range(3))}, {r('m00*m00+m01*m10+m02*m20')} AS sq00 FROM prt")
def _(spark, d):
    m = quat.matrix(quat.of())
    return particles(spark, d).select("particle_id", rnd(linear.det(m)).alias("det"), rnd(linear.trace(m)).alias("trace"), *four("s", linear.solve(m, (F.col("x"), F.col("y"), F.col("z")))), rnd(linear.matmul(m, m)[0][0]).alias("sq00"))


H = "h AS (SELECT i, j, 1.0/(i+j+1) AS v FROM generate_series(0, 29) a(i), generate_series(0, 29) b(j))"


@query("matmul_long", f"WITH {H} SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, {r('sum(a.v*b.v)')} AS v FROM h a JOIN h b ON a.j = b.i GROUP BY 1, 2")
def _(spark, d):
    h = linear.hilbert(spark, 30)
    return linear.product(linear.product(h, linear.eye(spark, 30)), h).select("i", "j", rnd(F.col("v")).alias("v"))


@query("matrix_vector_trace", f"WITH {H} SELECT i::INTEGER AS i, {r('sum(v)')} AS v, (SELECT {r('sum(v)')} FROM h WHERE i = j) AS trace FROM h GROUP BY 1")
def _(spark, d):
    h = linear.hilbert(spark, 30)
    ones = spark.range(30).select(F.col("id").cast("int").alias("i"), F.lit(1.0).alias("v"))
    trace = linear.dense_trace(h).first()["trace"]
    return linear.times(h, ones).select("i", rnd(F.col("v")).alias("v"), rnd(F.lit(trace)).alias("trace"))


@query("polytope_support", f"WITH {EMB} SELECT vec_id, {r('greatest(a[1], a[4], a[7])')} AS reach, {r('(a[1]+a[4]+a[7])/3')} AS mx FROM e")
def _(spark, d):
    pts = F.array(*[F.slice(F.col("a"), 1 + 3 * i, 3) for i in range(3)])
    s = vec.support(pts, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return vectors(spark, d).select("vec_id", rnd(F.get(s, F.lit(0))).alias("reach"), rnd(F.get(vec.mean(pts), F.lit(0))).alias("mx"))


# ---- particles ---------------------------------------------------------------------------------


def _level(name: str, kind: str) -> None:
    sql = f"WITH {PRT.format(kind=repr(kind))} SELECT particle_id, {r(level_sql('(p.x + 0.02)', '(p.y + 0.01)', '(p.z - 0.015)'))} AS level FROM prt p"
    query(name, sql)(lambda spark, d: particles(spark, d, kind).select("particle_id", rnd(shapes.level((F.col("x") + 0.02, F.col("y") + 0.01, F.col("z") - 0.015))).alias("level")))


for _name, _kind in (("level_superellipsoid", "superellipsoid"), ("level_sphere", "sphere"), ("level_prism", "prism"), ("level_ellipsoid", "ellipsoid")):
    _level(_name, _kind)

BETA = "gamma({a})*gamma({b})/gamma({a}+{b})"
VOL = f"CASE kind WHEN 'sphere' THEN 4*pi()/3*rx*rx*rx WHEN 'prism' THEN 8*rx*ry*rz WHEN 'ellipsoid' THEN 4*pi()/3*rx*ry*rz ELSE 2*rx*ry*rz*eps1*eps2*{BETA.format(a='(eps1/2)', b='(1+eps1)')}*{BETA.format(a='(eps2/2)', b='(1+eps2/2)')} END"


@query("particle_volume", f"WITH {MIXED} SELECT particle_id, {r(f'1000*({VOL})')} AS volume, {r('CASE WHEN kind = $$sphere$$ THEN 2*rx ELSE 2*sqrt(rx*rx+ry*ry+rz*rz) END')} AS diam FROM prt")
def _(spark, d):
    return particles(spark, d).select("particle_id", rnd(1000 * shapes.volume()).alias("volume"), rnd(shapes.diam()).alias("diam"))


@query("particle_obb", f"WITH {MIXED}, c AS (SELECT *, (CASE WHEN n & 1 = 1 THEN 1 ELSE -1 END)*rx AS u, (CASE WHEN (n >> 1) & 1 = 1 THEN 1 ELSE -1 END)*(CASE kind WHEN 'sphere' THEN rx ELSE ry END) AS v, (CASE WHEN (n >> 2) & 1 = 1 THEN 1 ELSE -1 END)*(CASE kind WHEN 'sphere' THEN rx ELSE rz END) AS w FROM prt, generate_series(0, 7) g(n)) SELECT particle_id, n::INTEGER AS n, {', '.join(f'{r(f'{a} + m0{j}*u + m1{j}*v + m2{j}*w')} AS {a}' for j, a in enumerate('xyz'))} FROM c")
def _(spark, d):
    v = particles(spark, d).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return v.select("particle_id", "n", *[rnd(c).alias(a) for a, c in zip("xyz", shapes.obb_corner(F.col("n")), strict=True)])


TOWARDS = (0.3, -0.2, 0.5)
LOCAL = [f"(m{i}0*{TOWARDS[0]}+m{i}1*({TOWARDS[1]})+m{i}2*{TOWARDS[2]})" for i in range(3)]


@query("particle_closest_point", f"WITH {MIXED} SELECT particle_id, {r(reach_sql(*LOCAL))} AS along, {r('1.0')} AS level FROM prt")
def _(spark, d):
    """How far the point closest to one beyond the particle lies in that direction, and that it is on the surface."""
    far = shapes.closest_point(tuple(F.col(c) + t for c, t in zip("xyz", TOWARDS, strict=True)))
    got = particles(spark, d).withColumns({f"c{c}": v for c, v in zip("xyz", far, strict=True)})
    along = sum((F.col(f"c{c}") - F.col(c)) * t for c, t in zip("xyz", TOWARDS, strict=True))
    return got.select("particle_id", rnd(along).alias("along"), rnd(shapes.level(tuple(F.col(f"c{c}") for c in "xyz"))).alias("level"))


@query("particle_edits", f"WITH {MIXED} SELECT particle_id, {', '.join(f'{r(f'm{i}0*({TOWARDS[1]})+m{i}1*{TOWARDS[2]}+m{i}2*{TOWARDS[0]}')} AS u{i}' for i in range(3))}, {r('1.5*rx')} AS rx, {r('x+0.1')} AS x FROM prt")
def _(spark, d):
    """Shifted, turned by a third round the diagonal (x to y to z to x) and scaled: a point's local coordinates, a radius and the centre."""
    rows = shapes.prepared(shapes.resized(shapes.turned(shapes.moved(particles(spark, d), 0.1, 0.2, 0.3), (0.5, 0.5, 0.5, 0.5)), 1.5))
    local = shapes.to_local(tuple(F.col(c) + t for c, t in zip("xyz", TOWARDS, strict=True)))
    return rows.select("particle_id", *four("u", local), rnd(F.col("rx")).alias("rx"), rnd(F.col("x")).alias("x"))


HALVES = {a: " + ".join(f"abs(m{i}{j}) * {q if i == 0 else f'CASE kind WHEN $$sphere$$ THEN rx ELSE {q} END'}" for i, q in enumerate(("rx", "ry", "rz"))) for j, a in enumerate("xyz")}


@query("particle_obb_bounds", f"WITH {MIXED} SELECT particle_id, {', '.join(f'{r(f'{a} {s} ({HALVES[a]})')} AS {e}{a}' for e, s in (('l', '-'), ('h', '+')) for a in 'xyz')} FROM prt")
def _(spark, d):
    return particles(spark, d).select("particle_id", *[rnd(c).alias(c0) for c, c0 in zip([*shapes.obb_bounds().low, *shapes.obb_bounds().high], [f"{e}{a}" for e in "lh" for a in "xyz"], strict=True)])


SG = "(CASE WHEN {x} < 0 THEN -1 ELSE 1 END)*pow(abs({x}), {e})"
CE, SE, CO, SO = "cos(x)", "sin(x)", "cos(6*y)", "sin(6*y)"


def power(x: str, e: str) -> str:
    return SG.format(x=x, e=e)


@query("particle_parametric", f"WITH {SUPER} SELECT particle_id, {r(f'rx*{power(CE, 'eps1')}*{power(CO, 'eps2')}')} AS u, {r(f'ry*{power(CE, 'eps1')}*{power(SO, 'eps2')}')} AS v, {r(f'rz*{power(SE, 'eps1')}')} AS w, {r(f'{power(SE, '(2-eps1)')}/rz')} AS nw, 1.0::DOUBLE AS level FROM prt")
def _(spark, d):
    p = shapes.parametric(F.col("x"), 6 * F.col("y"))
    n = shapes.normal_parametric(F.col("x"), 6 * F.col("y"))
    return particles(spark, d, "superellipsoid").select("particle_id", *[rnd(c).alias(a) for a, c in zip("uvw", p, strict=True)], rnd(n[2]).alias("nw"), rnd(shapes.superellipsoid_level(p)).alias("level"))


@query("particle_support", f"WITH {SUPER}, l AS (SELECT *, {', '.join(f'm{i}0*0.6 + m{i}2*0.8 AS d{i}' for i in range(3))} FROM prt) SELECT particle_id, {r(f'0.6*x + 0.8*z + ({reach_sql('d0', 'd1', 'd2')})')} AS reach, 1.0::DOUBLE AS level FROM l")
def _(spark, d):
    s = shapes.support((F.lit(0.6), F.lit(0.0), F.lit(0.8)))
    p = particles(spark, d, "superellipsoid").select("*", *[c.alias(f"s{a}") for a, c in zip("xyz", s, strict=True)])
    return p.select("particle_id", rnd(0.6 * F.col("sx") + 0.8 * F.col("sz")).alias("reach"), rnd(shapes.level((F.col("sx"), F.col("sy"), F.col("sz")))).alias("level"))


# ---- spatial joins --------------------------------------------------------------------------------

INSIDE = f"EXISTS (SELECT 1 FROM prt p WHERE {NEAR} AND {level_sql('t.x', 't.y', 't.z')} <= 1)"


@query("mask_semi_join", f"WITH {MIXED}, {PTS} SELECT {KEYS} FROM pts t WHERE {INSIDE}")
def mask_semi_join(spark, d):
    return spatial.points_inside(points(spark, d), particles(spark, d)).select(*KEY)


@query("points_outside", f"WITH {MIXED}, {PTS} SELECT {KEYS} FROM pts t WHERE NOT {INSIDE}")
def _(spark, d):
    return spatial.points_outside(points(spark, d), particles(spark, d)).select(*KEY)


@query("contains_count", f"WITH {MIXED}, {PTS} SELECT p.particle_id, count(*) AS n FROM pts t JOIN prt p ON {NEAR} WHERE {level_sql('t.x', 't.y', 't.z')} <= 1 GROUP BY 1")
def _(spark, d):
    return spatial.counts_inside(points(spark, d), particles(spark, d))


def _mask(name: str, kind: str, n: int) -> None:
    lattice = Lattice.over((0.0,) * 3, (1.0,) * 3, (n, n, n), kind)
    at = [f"{a!r}::DOUBLE + {h!r}::DOUBLE * {c}" for a, h, c in zip(lattice.low, lattice.spacing, "ijk", strict=True)]
    grid = f"t AS (SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, {', '.join(f'{e} AS {a}' for e, a in zip(at, 'xyz', strict=True))} FROM generate_series(0, {n - 1}) a(i), generate_series(0, {n - 1}) b(j), generate_series(0, {n - 1}) c(k))"
    query(name, f"WITH {MIXED}, {grid} SELECT i + {n} * (j + {n} * k) AS idx, i, j, k FROM t WHERE {INSIDE}")(lambda spark, d: spatial.lattice_mask(particles(spark, d), lattice).withColumn("idx", F.col("idx").cast("int")))


_mask("mask_grid", "centroid", 24)
_mask("mask_structured", "structured", 24)


@query("point_to_cell", f"WITH {PTS} SELECT {KEYS}, {', '.join(f'least(greatest(ceil({a} * 16) - 1, 0), 15)::INTEGER AS {c}' for a, c in zip('xyz', 'ijk', strict=True))} FROM pts")
def _(spark, d):
    return points(spark, d).select(*KEY, *[spatial.address(F.col(a), 0.0, 1.0, 4).alias(c) for a, c in zip("xyz", "ijk", strict=True)])


# ---- octrees ----------------------------------------------------------------------------------------

ROOT = octree.Root((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def _corner(n: int) -> str:
    return "+".join(f"(({a}0+{n >> i & 1}*s-p.{x})*({a}0+{n >> i & 1}*s-p.{x}))" for i, (a, x) in enumerate(zip("abc", "xyz", strict=True)))


DIST = "+".join(f"pow(greatest({a}0 - p.{x}, p.{x} - ({a}0 + s), 0), 2)" for a, x in zip("abc", "xyz", strict=True))
NVERT = " + ".join(f"(CASE WHEN ({_corner(n)})/(p.rx*p.rx) <= 1 THEN 1 ELSE 0 END)" for n in range(8))


def _tree(depth: int, bag: int) -> str:
    cells = f"g AS (SELECT d, i, j, k, 1.0/(1 << d) AS s, i/(1 << d)::DOUBLE AS a0, j/(1 << d)::DOUBLE AS b0, k/(1 << d)::DOUBLE AS c0 FROM generate_series(0, {depth}) q(d), generate_series(0, {2**depth - 1}) a(i), generate_series(0, {2**depth - 1}) b(j), generate_series(0, {2**depth - 1}) c(k) WHERE i < (1 << d) AND j < (1 << d) AND k < (1 << d))"
    st = f"st AS (SELECT g.d, g.i, g.j, g.k, count(p.particle_id) AS n, coalesce(max({NVERT}), 0) AS nvert FROM g LEFT JOIN prt p ON p.x BETWEEN a0-0.04 AND a0+s+0.04 AND p.y BETWEEN b0-0.04 AND b0+s+0.04 AND p.z BETWEEN c0-0.04 AND c0+s+0.04 AND {DIST} <= p.rx*p.rx GROUP BY 1,2,3,4)"
    par = f"lv AS (SELECT c.* FROM st c LEFT JOIN st p ON p.d = c.d - 1 AND p.i = c.i // 2 AND p.j = c.j // 2 AND p.k = c.k // 2 WHERE c.d = 0 OR (p.n >= {bag} AND p.nvert < 8))"
    leaf = f"leaf AS (SELECT d::INTEGER AS depth, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, n, nvert::INTEGER AS nvert FROM lv WHERE d = {depth} OR n < {bag} OR nvert = 8)"
    return f"WITH {SPHERES}, {cells}, {st}, {par}, {leaf}"


def _leaves(spark, d, depth=3, bag=1):
    return octree.refine(particles(spark, d, "sphere"), ROOT, depth, bag)[0]


@query("octree_cells_sphere", _tree(4, 1) + " SELECT * FROM leaf")
def _(spark, d):
    return _leaves(spark, d, 4).select("depth", "i", "j", "k", "n", "nvert")


@query("octree_adaptive", _tree(4, 8) + " SELECT * FROM leaf")
def _(spark, d):
    return _leaves(spark, d, 4, 8).select("depth", "i", "j", "k", "n", "nvert")


@query("octree_leaf_stats", _tree(3, 1) + " SELECT count(*) AS n_leaves, max(depth) AS max_depth, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (nvert = 8) AS n_full, sum(n)::BIGINT AS n_references FROM leaf")
def _(spark, d):
    return octree.statistics(_leaves(spark, d))


@query("octree_rollup", _tree(3, 1) + " SELECT t::INTEGER AS depth, (i // (1 << (depth - t)))::INTEGER AS i, (j // (1 << (depth - t)))::INTEGER AS j, (k // (1 << (depth - t)))::INTEGER AS k, count(*) AS n_leaves, sum(n)::BIGINT AS sum_n, sum(nvert)::BIGINT AS sum_nvert FROM leaf, generate_series(0, 2) g(t) WHERE t <= depth GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return octree.rollup(_leaves(spark, d), 2)


@query("octree_points", _tree(3, 1) + f", {PTS} SELECT {KEYS}, depth, i, j, k FROM pts JOIN leaf ON i = least(greatest(ceil(x * (1 << depth)) - 1, 0), (1 << depth) - 1) AND j = least(greatest(ceil(y * (1 << depth)) - 1, 0), (1 << depth) - 1) AND k = least(greatest(ceil(z * (1 << depth)) - 1, 0), (1 << depth) - 1)")
def _(spark, d):
    return octree.leaf_of_points(points(spark, d), _leaves(spark, d), ROOT).select(*KEY, "depth", "i", "j", "k")


@query("octree_superellipsoids")
def _(spark, d):
    return octree.refine(particles(spark, d), ROOT, 4)[0].select("depth", "i", "j", "k", "n", "nvert")


@query("octree_graded")
def _(spark, d):
    return octree.grade(_leaves(spark, d, 4, 8))


# ---- meshes --------------------------------------------------------------------------------------------

CORNERS = "v AS (SELECT leaf.*, n_ AS v, (i + (n_ & 1)) * (1 << (16 - depth)) AS gx, (j + ((n_ >> 1) & 1)) * (1 << (16 - depth)) AS gy, (k + ((n_ >> 2) & 1)) * (1 << (16 - depth)) AS gz FROM leaf, generate_series(0, 7) g(n_))"
NODES = "nd AS (SELECT gx, gy, gz, row_number() OVER (ORDER BY gz, gy, gx) - 1 AS node_id FROM (SELECT DISTINCT gx, gy, gz FROM v))"
ELEMS = "el AS (SELECT depth, i, j, k, nvert AS marker, row_number() OVER (ORDER BY depth, k, j, i) - 1 AS elem_id FROM leaf)"
CONN = "cn AS (SELECT el.elem_id, el.marker, v.v, nd.node_id FROM el JOIN v USING (depth, i, j, k) JOIN nd USING (gx, gy, gz))"
MESH = _tree(3, 1) + f", {CORNERS}, {NODES}, {ELEMS}, {CONN}, ms AS (SELECT elem_id, marker, list(node_id ORDER BY v) AS nodes FROM cn GROUP BY 1, 2)"


def _mesh(spark, d):
    return mesh.from_cells(_leaves(spark, d), ROOT)


@query("mesh_nodes", MESH + f" SELECT node_id, {', '.join(f'{r(f'g{a} / 65536.0')} AS {a}' for a in 'xyz')} FROM nd")
def _(spark, d):
    return _mesh(spark, d)[0].select("node_id", *[rnd(F.col(a)).alias(a) for a in "xyz"])


@query("mesh_elements", MESH + " SELECT elem_id, 11 AS vtk_type, nodes, marker FROM ms")
def _(spark, d):
    return _mesh(spark, d)[1]


@query("mesh_hexahedra", MESH + " SELECT elem_id, 12 AS vtk_type, [nodes[1],nodes[2],nodes[4],nodes[3],nodes[5],nodes[6],nodes[8],nodes[7]] AS nodes, marker FROM ms")
def _(spark, d):
    return mesh.to_hexahedra(_mesh(spark, d)[1])


FACES_SQL = "fc AS (" + " UNION ALL ".join(f"SELECT elem_id, {n} AS face, [{', '.join(f'nodes[{c + 1}]' for c in f)}] AS nodes FROM ms" for n, f in enumerate(mesh.FACES[mesh.VOXEL])) + ")"


@query("mesh_faces", f"{MESH}, {FACES_SQL} SELECT * FROM fc")
def _(spark, d):
    return mesh.faces(_mesh(spark, d)[1])


HEX = "hx AS (SELECT elem_id, [nodes[1],nodes[2],nodes[4],nodes[3],nodes[5],nodes[6],nodes[8],nodes[7]] AS nodes FROM ms)"


def _faces_sql(source: str, table: tuple) -> str:
    return " UNION ALL ".join(f"SELECT elem_id, {n} AS face, [{', '.join(f'nodes[{c + 1}]' for c in f)}] AS nodes FROM {source}" for n, f in enumerate(table))


@query("mesh_hex_faces", f"{MESH}, {HEX} {_faces_sql('hx', mesh.FACES[mesh.HEXAHEDRON])}")
def _(spark, d):
    return mesh.faces(mesh.to_hexahedra(_mesh(spark, d)[1]), mesh.HEXAHEDRON)


@query("mesh_pixel_edges", f"{MESH}, px AS (SELECT elem_id, nodes[1:4] AS nodes FROM ms) {_faces_sql('px', mesh.FACES[mesh.PIXEL])}")
def _(spark, d):
    """Edges of the lower faces of all voxels, as pixels."""
    return mesh.faces(_mesh(spark, d)[1].withColumns({"nodes": F.slice("nodes", 1, 4), "vtk_type": F.lit(mesh.PIXEL)}), mesh.PIXEL)


@query("mesh_quad_edges", f"{MESH}, qd AS (SELECT elem_id, [nodes[1],nodes[2],nodes[4],nodes[3]] AS nodes FROM ms) {_faces_sql('qd', mesh.FACES[mesh.QUAD])}")
def _(spark, d):
    """The same as quads, whose corners go round."""
    return mesh.faces(mesh.to_quads(_mesh(spark, d)[1].withColumn("nodes", F.slice("nodes", 1, 4))), mesh.QUAD)


@query("mesh_boundary", f"{MESH}, {FACES_SQL} SELECT elem_id, face, nodes FROM fc QUALIFY count(*) OVER (PARTITION BY list_sort(nodes)) = 1")
def _(spark, d):
    return mesh.boundary(_mesh(spark, d)[1])


@query("mesh_node2elem", f"{MESH} SELECT node_id, list(elem_id ORDER BY elem_id) AS elements FROM cn GROUP BY 1")
def _(spark, d):
    return mesh.node_elements(_mesh(spark, d)[1])


@query("mesh_submesh", MESH + ", ke AS (SELECT elem_id AS old, row_number() OVER (ORDER BY elem_id) - 1 AS elem_id, marker FROM ms WHERE marker IN (0, 1)), kn AS (SELECT node_id AS o, row_number() OVER (ORDER BY node_id) - 1 AS nw FROM (SELECT DISTINCT node_id FROM cn JOIN ke ON cn.elem_id = ke.old)) SELECT ke.elem_id, 11 AS vtk_type, list(nw ORDER BY v) AS nodes, ke.marker FROM ke JOIN cn ON cn.elem_id = ke.old JOIN kn ON kn.o = cn.node_id GROUP BY 1, 4")
def _(spark, d):
    return mesh.submesh(*_mesh(spark, d), [0, 1])[1]


@query("mesh_bbox", MESH + f" SELECT {', '.join(f'{r(f'{f}(g{a}) / 65536.0')} AS {e}{a}' for e, f in (('l', 'min'), ('h', 'max')) for a in 'xyz')}, (SELECT count(*) * 8 FROM ms) AS n_tracked FROM nd")
def _(spark, d):
    nodes, elements = _mesh(spark, d)
    n = mesh.tracked_nodes(elements).first()["n_tracked"]
    return mesh.box(nodes).select(*six(Box.of()), F.lit(n).cast("long").alias("n_tracked"))


@query("oct_cell_faces")
def _(spark, d):
    cells = particles(spark, d).select(F.col("particle_id").alias("elem_id"), F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.col("particle_id") * 26 + i).alias("nodes"), F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: (i < 8) | ((F.col("particle_id") + i) % 3 == 0)).alias("used"))
    return mesh.oct_faces(cells)


@query("dat_roundtrip", ORACLE_SQL["mask_grid"])
def _(spark, d):
    """The mask of mask_grid written as a .dat file and read again."""
    import uuid

    lattice = Lattice.over((0.0,) * 3, (1.0,) * 3, (24,) * 3)
    from lattica.operators.ids import settle

    settle(spark.range(1))
    path = f"{spark.sparkContext.getCheckpointDir()}/dat-{uuid.uuid4().hex}"
    files.write_dat(spatial.lattice_markers(particles(spark, d), lattice), lattice.dims, path)
    got, _ = files.read_dat(spark, path)
    return got.filter("marker = 1").select(F.col("idx").cast("int").alias("idx"), "i", "j", "k")


@query("dat_many_files", ORACLE_SQL["mask_grid"])
def _(spark, d):
    """The same, with the mask in many part files, as a large one would be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return QUERIES["dat_roundtrip"](spark, d)
    finally:
        spark.conf.set(name, before)


# ---- stencils and solvers ------------------------------------------------------------------------------------

N = 12
DIMS, STEP = (N, N, N), (0.5, 0.25, 0.2)
GRID = f"f AS (SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, sin(i + 2.0*j) + cos(3.0*k) AS v, (i*7 + j*5 + k*3) % 11 = 0 AS solid FROM generate_series(0, {N - 1}) a(i), generate_series(0, {N - 1}) b(j), generate_series(0, {N - 1}) c(k))"


def field(spark: SparkSession) -> DataFrame:
    i, j, k = F.col("id") % N, F.floor(F.col("id") / N) % N, F.floor(F.col("id") / (N * N))
    return spark.range(N**3).select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k")).withColumn("v", F.sin(F.col("i") + 2.0 * F.col("j")) + F.cos(3.0 * F.col("k")))


def solid(spark: SparkSession) -> DataFrame:
    return field(spark).filter("(i * 7 + j * 5 + k * 3) % 11 = 0").select("i", "j", "k")


def _at(frm: str, name: str, axis: int, by: int) -> str:
    eq = [f"{name}.{c} = " + (f"(f.{c} + {by} + {N}) % {N}" if n == axis else f"f.{c}") for n, c in enumerate("ijk")]
    return f"JOIN {frm} {name} ON {' AND '.join(eq)}"


LAP = " ".join(_at("f", f"n{a}{s}", a, b) for a in range(3) for s, b in (("p", 1), ("m", -1)))
LAPV = " + ".join(f"(n{a}p.v - 2*f.v + n{a}m.v)/{STEP[a] ** 2!r}" for a in range(3))


@query("laplacian", f"WITH {GRID} SELECT f.i, f.j, f.k, {r(LAPV)} AS v FROM f {LAP} WHERE NOT f.solid")
def _(spark, d):
    return stencil.laplacian(field(spark), DIMS, STEP, solid(spark)).select("i", "j", "k", rnd(F.col("v")).alias("v"))


def _difference(name: str, other: int) -> None:
    query(name, f"WITH {GRID} SELECT f.i, f.j, f.k, {r(f'(f.v - n.v)/{STEP[1]}')} AS v FROM f {_at('f', 'n', 1, other)} WHERE NOT f.solid")(lambda spark, d: stencil.difference(field(spark), DIMS, STEP, 1, other, solid(spark)).select("i", "j", "k", rnd(F.col("v")).alias("v")))


_difference("diff_forward", 1)
_difference("diff_backward", -1)


@query("pressure_laplacian", f"WITH {GRID} SELECT f.i, f.j, f.k, {r(' + '.join(f'(f.v - 2*a{a}.v + b{a}.v)/{STEP[a] ** 2!r}' for a in range(3)))} AS v FROM f {' '.join(_at('f', f'{n}{a}', a, b) for a in range(3) for n, b in (('a', 1), ('b', 2)))}")
def _(spark, d):
    return stencil.pressure_laplacian(field(spark), DIMS, STEP).select("i", "j", "k", rnd(F.col("v")).alias("v"))


@query("field_dot", f"WITH {GRID} SELECT {r('sum(v*v)')} AS dot, {r('sum(v)')} AS total FROM f")
def _(spark, d):
    f = field(spark)
    return f.agg(rnd(F.lit(solvers.norm2(f))).alias("dot"), rnd(F.sum("v")).alias("total"))


@query("conjugate_gradient", f"WITH {GRID} SELECT i, j, k, round(v, 4) + 0.0 AS v FROM f")
def _(spark, d):
    """Solves (1 - 0.01 lap) x = (1 - 0.01 lap) f, whose answer is f."""
    apply = lambda f: stencil.combine((f, 1.0), (stencil.laplacian(f, DIMS, STEP), -0.01))
    x = solvers.conjugate_gradient(apply, apply(field(spark)), 14)
    return x.select("i", "j", "k", F.round("v", 4).alias("v"))


@query("gauss_seidel", "SELECT i::INTEGER AS i, round((i + 1.0)::DOUBLE, 4) AS v FROM generate_series(0, 19) g(i)")
def _(spark, d):
    a = linear.dense(spark, 20, 20, F.when(F.col("i") == F.col("j"), 4.0).when(F.abs(F.col("i") - F.col("j")) == 1, -1.0).otherwise(0.0))
    x = spark.range(20).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("v"))
    return solvers.gauss_seidel(a, linear.times(a, x)).select("i", F.round("v", 4).alias("v"))


@query("dgs_step")
def _(spark, d):
    zero = field(spark).withColumn("v", F.lit(0.0))
    one = field(spark).withColumn("v", F.lit(1.0))
    masks = {n: solid(spark) for n in "uvwp"}
    out = solvers.distributive_relaxation(dict.fromkeys("uvwp", zero), {"u": one, "v": zero, "w": zero, "p": zero}, DIMS, STEP, masks, steps=2)
    parts = [f.select(F.lit(n).alias("field"), "i", "j", "k", rnd(F.col("v")).alias("v")) for n, f in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
