"""Closed axis-aligned boxes: a pair (low, high) of 3-tuples of Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

V = tuple[Column, Column, Column]
#: Corners in hexahedron order, by their number in voxel order (bit 0 is x, bit 1 y, bit 2 z).
HEX_ORDER = (0, 1, 3, 2, 4, 5, 7, 6)


@dataclass(frozen=True)
class Box:
    low: V
    high: V

    @classmethod
    def of(cls, low: str = "l", high: str = "h") -> Box:
        return cls(*(tuple(F.col(f"{p}{a}") for a in "xyz") for p in (low, high)))

    @classmethod
    def from_points(cls, a: V, b: V) -> Box:
        """The box two opposite corners span, in whichever order."""
        return cls(tuple(map(F.least, a, b)), tuple(map(F.greatest, a, b)))

    def combine(self, other: Box) -> Box:
        return Box(tuple(map(F.least, self.low, other.low)), tuple(map(F.greatest, self.high, other.high)))

    @property
    def center(self) -> V:
        return tuple((a + b) / 2 for a, b in zip(self.low, self.high, strict=True))

    @property
    def side(self) -> V:
        return tuple(b - a for a, b in zip(self.low, self.high, strict=True))

    @property
    def volume(self) -> Column:
        a, b, c = self.side
        return a * b * c

    @property
    def diam(self) -> Column:
        a, b, c = self.side
        return F.sqrt(a * a + b * b + c * c)

    @property
    def valid(self) -> Column:
        a, b, c = self.side
        return (a > 0) & (b > 0) & (c > 0)

    def vertex(self, n: Column | int) -> V:
        """Corner n in voxel order."""
        n = F.lit(n) if isinstance(n, int) else n
        return tuple(F.when(F.shiftright(n, i).bitwiseAND(F.lit(1)) == 1, b).otherwise(a) for i, (a, b) in enumerate(zip(self.low, self.high, strict=True)))

    def hexvertex(self, n: Column) -> V:
        return self.vertex(F.get(F.array(*map(F.lit, HEX_ORDER)), n))

    def face_center(self, n: Column) -> V:
        """Faces 0 to 5 look along -x, -y, -z, x, y, z."""
        return tuple(F.when(n == i, a).when(n == i + 3, b).otherwise(c) for i, (a, b, c) in enumerate(zip(self.low, self.high, self.center, strict=True)))

    @staticmethod
    def face_normal(n: Column) -> V:
        return tuple(F.when(n == i, -1.0).when(n == i + 3, 1.0).otherwise(0.0) for i in range(3))

    def contains(self, p: V) -> Column:
        (x, y, z), (a, b, c), (d, e, f) = p, self.low, self.high
        return (x >= a) & (x <= d) & (y >= b) & (y <= e) & (z >= c) & (z <= f)

    def contains_strictly(self, p: V) -> Column:
        (x, y, z), (a, b, c), (d, e, f) = p, self.low, self.high
        return (x > a) & (x < d) & (y > b) & (y < e) & (z > c) & (z < f)

    def contains_box(self, other: Box) -> Column:
        return self.contains(other.low) & self.contains(other.high)

    def intersects(self, other: Box) -> Column:
        """Overlap in every axis; touching counts."""
        out = F.lit(True)
        for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True):
            out = out & (a <= d) & (c <= b)
        return out

    def intersects_by_vertex(self, other: Box) -> Column:
        """Whether either holds a corner of the other: misses boxes that cross without."""
        # Corners take each axis' bound apart, so the axes can be looked at one by one.
        holds = held = F.lit(True)
        for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True):
            holds = holds & (c.between(a, b) | d.between(a, b))
            held = held & (a.between(c, d) | b.between(c, d))
        return holds | held

    def support(self, d: V) -> V:
        """The corner furthest along d; the low side where d is 0."""
        return tuple(F.when(x > 0, b).otherwise(a) for x, a, b in zip(d, self.low, self.high, strict=True))

    def shift(self, v: V) -> Box:
        return Box(tuple(a + x for a, x in zip(self.low, v, strict=True)), tuple(b + x for b, x in zip(self.high, v, strict=True)))

    def scale(self, s) -> Box:
        """Scaled about its centre."""
        c, half = self.center, tuple(x / 2 * s for x in self.side)
        return Box.from_points(tuple(a - h for a, h in zip(c, half, strict=True)), tuple(a + h for a, h in zip(c, half, strict=True)))

    def with_low(self, v: V) -> Box:
        """The box that the new corner and the opposite one span."""
        return Box.from_points(v, self.high)

    def with_high(self, v: V) -> Box:
        return Box.from_points(self.low, v)

    def distance2(self, p: V) -> Column:
        """Squared distance of a point; 0 inside."""
        out = F.lit(0.0)
        for x, a, b in zip(p, self.low, self.high, strict=True):
            d = F.greatest(a - x, x - b, F.lit(0.0))
            out = out + d * d
        return out

    def columns(self, low: str = "l", high: str = "h") -> list[Column]:
        return [c.alias(f"{p}{a}") for p, v in ((low, self.low), (high, self.high)) for a, c in zip("xyz", v, strict=True)]
