"""Octrees over particles as tables of cells (depth, i, j, k), refined level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import shapes
from lattica.functions.box import Box
from lattica.operators.collide import meeting
from lattica.operators.ids import settle

CELL = ["depth", "i", "j", "k"]
DEEPEST = 16


@dataclass(frozen=True)
class Root:
    low: tuple[float, float, float]
    high: tuple[float, float, float]

    def box(self, depth: Column | None = None) -> Box:
        """The box of the row's cell."""
        n = F.pow(F.lit(2.0), F.col("depth") if depth is None else depth)
        side = [F.lit(b - a) / n for a, b in zip(self.low, self.high, strict=True)]
        at = [F.col(c) for c in "ijk"]
        return Box(tuple(F.lit(a) + s * c for a, s, c in zip(self.low, side, at, strict=True)), tuple(F.lit(a) + s * (c + 1) for a, s, c in zip(self.low, side, at, strict=True)))


def children(cells: DataFrame) -> DataFrame:
    """The eight children of each cell, in voxel order: child c has number c, and i, j, k take its bits."""
    more = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = lambda n: F.shiftright("c", n).bitwiseAND(F.lit(1))
    out = more.withColumns({a: (2 * F.col(a) + bit(n)).cast("int") for n, a in enumerate("ijk")}).withColumn("depth", (F.col("depth") + 1).cast("int"))
    return (out.withColumn("id", 8 * F.col("id") + 1 + F.col("c")) if "id" in cells.columns else out).drop("c")


def corners_inside(root: Root) -> Column:
    """How many of the cell's corners lie in the row's particle."""
    b = root.box()
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, n: s + shapes.contains(b.vertex(n)).cast("int"))


def refine(particles: DataFrame, root: Root, depth: int, least_bag: int = 1) -> tuple[DataFrame, DataFrame]:
    """(leaves, bag) after at most ``depth`` rounds of splitting.

    leaves: depth, i, j, k, id, n (particles that meet the cell), nvert (most
    corners in one of them). bag: the leaf's particles, as depth, i, j, k,
    particle_id. A leaf is split if it meets ``least_bag`` particles or more (8 for
    the adaptive way) and no particle holds all of its corners. Each round is one
    job whose result is written; cells that aren't split go no further.
    """
    if depth > DEEPEST:
        raise ValueError(f"cells deeper than {DEEPEST} can't be addressed")
    spark = particles.sparkSession
    cells = spark.createDataFrame([(0, 0, 0, 0, 0)], "depth int, i int, j int, k int, id long")
    bag = shapes.prepared(particles).select(*[F.lit(0).alias(c) for c in CELL], "particle_id", "kind", *shapes.COLUMNS, *shapes.ROTATION).withColumn("nvert", corners_inside(root))
    done, bags = None, None
    for level in range(depth + 1):
        bag = settle(bag)
        counts = bag.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max("nvert").alias("nvert"))
        level_cells = settle(cells.join(counts, CELL, "left").select(*CELL, "id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nvert", F.lit(0)).alias("nvert")))
        split = F.lit(level < depth) & (F.col("n") >= least_bag) & (F.col("nvert") < 8)
        stay = level_cells.filter(~split)
        done = stay if done is None else done.unionByName(stay)
        kept = bag.join(stay.select(*CELL), CELL, "left_semi").select(*CELL, "particle_id")
        bags = kept if bags is None else bags.unionByName(kept)
        parents = level_cells.filter(split)
        if level == depth or not parents.head(1):
            break
        cells = children(parents.select(*CELL, "id"))
        going = bag.drop("nvert").join(parents.select(*CELL), CELL, "left_semi")
        # The tests take far longer than their bytes tell, so the number of tasks isn't left to adaptive merging.
        going = going.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "particle_id")
        bag = meeting(children(going).select("*", *root.box().columns())).drop(*[f"{e}{a}" for e in "lh" for a in "xyz"]).withColumn("nvert", corners_inside(root))
    return done, bags


def statistics(leaves: DataFrame) -> DataFrame:
    """One row: leaves, deepest, how many are empty and full, and references to particles."""
    return leaves.agg(
        F.count(F.lit(1)).alias("n_leaves"), F.max("depth").alias("max_depth"), F.count_if(F.col("n") == 0).alias("n_empty"),
        F.count_if(F.col("nvert") == 8).alias("n_full"), F.sum("n").alias("n_references"),
    )


def rollup(leaves: DataFrame, depth: int) -> DataFrame:
    """Every cell down to ``depth`` that has leaves below or is one, with sums of n and nvert over them."""
    up = leaves.withColumn("to", F.explode(F.sequence(F.lit(0), F.least(F.col("depth"), F.lit(depth)))))
    shift = F.pow(F.lit(2.0), F.col("depth") - F.col("to"))
    keyed = up.select(F.col("to").cast("int").alias("depth"), *[F.floor(F.col(a) / shift).cast("int").alias(a) for a in "ijk"], "n", "nvert")
    return keyed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("n").alias("sum_n"), F.sum("nvert").alias("sum_nvert"))


def leaf_of_points(points: DataFrame, leaves: DataFrame, root: Root) -> DataFrame:
    """Points with the leaf that holds them: a join by address for each depth that occurs (DEEPEST at most)."""
    from lattica.operators.spatial import address

    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    out = None
    for d in depths:
        at = points.withColumns({c: address(F.col(x), lo, hi, d) for c, x, lo, hi in zip("ijk", "xyz", root.low, root.high, strict=True)})
        got = at.join(leaves.filter(F.col("depth") == d).select(*CELL), ["i", "j", "k"])
        out = got if out is None else out.unionByName(got)
    return out


def grade(leaves: DataFrame, rounds: int = DEEPEST) -> DataFrame:
    """Leaves (depth, i, j, k) split until neighbours across faces differ by one level at most."""
    cells = settle(leaves.select(*CELL))
    for _ in range(rounds):
        deep = cells.filter("depth >= 2")
        near = None
        for a in "ijk":
            for d in (-1, 1):
                n = deep.withColumn(a, F.col(a) + d).filter((F.col(a) >= 0) & (F.col(a) < F.pow(F.lit(2.0), F.col("depth"))))
                near = n if near is None else near.unionByName(n)
        # A leaf two or more levels above a neighbour's address must be split.
        up = near.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("depth") - 2)))
        above = up.select(F.col("to").alias("depth"), *[F.floor(F.col(a) / F.pow(F.lit(2.0), F.col("depth") - F.col("to"))).cast("int").alias(a) for a in "ijk"]).distinct()
        coarse = settle(cells.join(above, CELL, "left_semi"))
        if not coarse.head(1):
            break
        cells = settle(cells.join(coarse, CELL, "left_anti").unionByName(children(coarse).select(*CELL)))
    return cells
