"""How many boxes overlap each box, without a row for each pair.

Boxes that are counted stand in one cell each, that of their centre; cells are as
wide as their size class (powers of two from twice the mean on). A box asks all
cells in reach of each class. In a cell the comparisons of an axis are sets of
bits, one for each rank of its bounds, so that a pair costs six bits rather than a
row. Cells with very many boxes are dealt to several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.ids import settle

CHUNK, BATCH, FEW = 1 << 12, 1 << 11, 1 << 9
#: A task takes at most about so many boxes that are counted and that ask.
MOST_COUNTED, MOST_ASKING = 1 << 17, 1 << 19
BOUNDS = [f"{e}{a}" for e in "lh" for a in "xyz"]
CELL = ["c", "bx", "by", "bz"]


def _chunks(low: np.ndarray, high: np.ndarray, at: np.ndarray):
    """Rows at, halved along the widest axis until CHUNK are left."""
    if len(at) <= CHUNK:
        yield at
        return
    mid = low[at] / 2 + high[at] / 2
    axis = int(np.argmax(mid.max(0) - mid.min(0)))
    order = np.argpartition(mid[:, axis], len(at) // 2)
    yield from _chunks(low, high, at[order[: len(at) // 2]])
    yield from _chunks(low, high, at[order[len(at) // 2 :]])


def _first(bounds: np.ndarray) -> np.ndarray:
    """Row n: the n least of the bounds, as bits."""
    k = len(bounds)
    rank = np.empty(k, np.int32)
    rank[np.argsort(bounds, kind="stable")] = np.arange(k, dtype=np.int32)
    wide = np.zeros((k + 1, -(-k // 64) * 8), np.uint8)
    bits = np.packbits(rank < np.arange(k + 1, dtype=np.int32)[:, None], axis=1)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.uint64)


def _direct(ql, qh, low, high, by_vertex):
    one = lambda x: x[:, None, :]
    hit = ((low <= one(qh)) & (high >= one(ql))).all(2)
    if by_vertex:
        hit &= ((low >= one(ql)) | (high <= one(qh))).all(2) | ((low <= one(ql)) | (high >= one(qh))).all(2)
    return hit.sum(1)


def _by_bits(ql, qh, low, high, by_vertex):
    lows, highs = [np.sort(low[:, a]) for a in range(3)], [np.sort(high[:, a]) for a in range(3)]
    first = [(_first(low[:, a]), _first(high[:, a])) for a in range(3)]
    out = np.empty(len(ql), np.int64)
    for s in range(0, len(ql), BATCH):
        p, q = ql[s : s + BATCH], qh[s : s + BATCH]
        hit = holds = held = None
        for a, (of_low, of_high) in enumerate(first):
            rank = lambda x, v, side: np.searchsorted(x[a], v[:, a], side)  # noqa: E731, B023
            some = of_low[rank(lows, q, "right")]
            some &= ~of_high[rank(highs, p, "left")]
            hit = some if a == 0 else np.bitwise_and(hit, some, out=hit)
            if by_vertex:  # of boxes that overlap
                one = ~of_low[rank(lows, p, "left")] | of_high[rank(highs, q, "right")]
                two = of_low[rank(lows, p, "right")] | ~of_high[rank(highs, q, "left")]
                holds, held = (one, two) if a == 0 else (holds & one, held & two)
        out[s : s + BATCH] = np.bitwise_count(hit & (holds | held) if by_vertex else hit).sum(1, dtype=np.int64)
    return out


def count_overlaps(ql: np.ndarray, qh: np.ndarray, low: np.ndarray, high: np.ndarray, by_vertex: bool = False) -> np.ndarray:
    """For each box ql..qh, how many of low..high overlap it; by_vertex: and one holds a corner of the other."""
    n = np.zeros(len(ql), np.int64)
    for at in _chunks(low, high, np.arange(len(low))) if len(low) else ():
        l, h = low[at], high[at]  # noqa: E741
        ask = ((ql <= h.max(0)) & (qh >= l.min(0))).all(1)
        if not by_vertex:
            every = ask & ((ql <= h.min(0)) & (qh >= l.max(0))).all(1)
            n[every] += len(at)
            ask &= ~every
        (who,) = np.nonzero(ask)
        if len(who):
            n[who] += (_direct if len(who) < FEW and len(at) * len(who) < 1 << 20 else _by_bits)(ql[who], qh[who], l, h, by_vertex)
    return n


def overlap_counts(left: DataFrame, right: DataFrame, left_id: str, by_vertex: bool = False) -> DataFrame:
    """(left_id, n): how many boxes (lx..hz) of right each row of left overlaps, touching ones included; rows without any are left out. Boxes with a null bound overlap none. ids are longs and tell left's rows apart."""
    whole = lambda d, *more: d.select(*more, *[F.col(c).cast("double").alias(c) for c in BOUNDS]).dropna(subset=BOUNDS)
    ask, counted = whole(left, F.col(left_id).cast("long").alias("id")), whole(right)
    side = F.greatest(*[F.abs(F.col(f"h{a}") - F.col(f"l{a}")) for a in "xyz"])
    means = [d.agg(F.avg(side)).first()[0] or 0.0 for d in (ask, counted)]
    base = math.ceil(math.log2(max(means))) + 1 if max(means) > 0 else 0
    cell = F.pow(F.lit(2.0), F.col("c"))
    floor = lambda x: F.floor(x / cell).cast("long")
    counted = counted.withColumn("c", F.when(side <= 2.0**base, F.lit(base)).otherwise(F.ceil(F.log2(side))).cast("int"))
    reach = [(r["c"], float(r["s"]) / 2) for r in counted.groupBy("c").agg(F.max(side).alias("s")).collect()]  # a row for each power of two
    counted = counted.withColumns({f"b{a}": floor(F.col(f"l{a}") / 2 + F.col(f"h{a}") / 2) for a in "xyz"})
    if not reach:
        return ask.select(F.col("id").alias(left_id), F.lit(0).cast("long").alias("n")).limit(0)
    ask = ask.withColumn("r", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in reach]))).select("id", *BOUNDS, "r.*")
    for a in "xyz":
        low, high = F.least(f"l{a}", f"h{a}"), F.greatest(f"l{a}", f"h{a}")
        room = F.col("s") + 1e-9 * cell + 1e-14 * (F.abs(low) + F.abs(high))
        ask = ask.withColumn(f"b{a}", F.explode(F.sequence(floor(low - room), floor(high + room))))
    # Only cells with more rows than a task takes; there are at most as many as such tasks.
    many = lambda d, most, name: d.groupBy(*CELL).count().filter(F.col("count") > most).select(*CELL, F.ceil(F.col("count") / most).cast("int").alias(name))
    more = many(counted, MOST_COUNTED, "nr").join(many(ask, MOST_ASKING, "nl"), CELL, "full")
    more = settle(more)
    parts = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)
    one = lambda n: F.floor(F.rand(7) * F.coalesce(n, F.lit(1))).cast("int")
    ask = ask.join(F.broadcast(more), CELL, "left").withColumn("pl", one("nl")).withColumn("pr", F.explode(parts("nr"))).drop("nl", "nr", "s")
    counted = counted.join(F.broadcast(more), CELL, "left").withColumn("pr", one("nr")).withColumn("pl", F.explode(parts("nl"))).drop("nl", "nr")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        f = lambda t, e: np.stack([t[f"{e}{x}"].to_numpy() for x in "xyz"], 1)
        n = count_overlaps(f(a, "l"), f(a, "h"), f(b, "l"), f(b, "h"), by_vertex)
        at = pa.array(np.flatnonzero(n))
        return pa.table({"id": a["id"].take(at), "n": pa.array(n).take(at)})

    key = [*CELL, "pl", "pr"]
    got = ask.groupBy(*key).cogroup(counted.groupBy(*key)).applyInArrow(count, "id long, n long")
    return got.groupBy(F.col("id").alias(left_id)).agg(F.sum("n").alias("n"))
