"""Points in particles, cell by cell: a cell's points stand in a tree of boxes, and a particle takes or leaves whole boxes.

The root of the level that is linear in the distance from a particle's centre is
a norm, as all kinds are convex: by how much the norm of a box's centre differs
from 1 tells, beside the norm of half its diagonal, that all of the box lies
inside or outside. Only points of boxes that stay open at the tree's leaves are
tested one by one, by the level itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

LEAF, FIRST, BATCH = 16, 256, 2048
NUMBERS = ["rx", "ry", "rz", "eps1", "eps2", "x", "y", "z", *[f"m{i}{j}" for i in range(3) for j in range(3)]]
#: What rounding may do to a norm near 1.
ROOM = 1e-9


class Particles:
    """Columns of particles of one kind."""

    def __init__(self, kind: str, numbers: np.ndarray):
        self.kind, self.r, self.e, self.at, self.m = kind, numbers[:, :3], numbers[:, 3:5], numbers[:, 5:8], numbers[:, 8:].reshape(-1, 3, 3)

    def take(self, n: np.ndarray) -> Particles:
        out = object.__new__(Particles)
        out.kind, out.r, out.e, out.at, out.m = self.kind, self.r[n], self.e[n], self.at[n], self.m[n]
        return out

    def local(self, p: np.ndarray) -> list[np.ndarray]:
        d = p - self.at
        return [self.m[:, i, 0] * d[:, 0] + self.m[:, i, 1] * d[:, 1] + self.m[:, i, 2] * d[:, 2] for i in range(3)]

    def spread(self, half: np.ndarray) -> list[np.ndarray]:
        """How far boxes of these half sides reach along the local axes."""
        m = np.abs(self.m)
        return [m[:, i, 0] * half[:, 0] + m[:, i, 1] * half[:, 1] + m[:, i, 2] * half[:, 2] for i in range(3)]

    def norm(self, q: list[np.ndarray]) -> np.ndarray:
        if self.kind == "sphere":
            return np.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2]) / self.r[:, 0]
        a, b, c = (np.abs(q[i]) / self.r[:, i] for i in range(3))
        if self.kind == "prism":
            return np.maximum(np.maximum(a, b), c)
        if self.kind == "ellipsoid":
            return np.sqrt(a * a + b * b + c * c)

        def joined(u, v, e):
            more = np.maximum(u, v)
            return more * np.power(1 + np.power(np.minimum(u, v) / np.where(more > 0, more, 1), 2 / e), e / 2)

        return joined(joined(a, b, self.e[:, 1]), c, self.e[:, 0])

    def contain(self, p: np.ndarray) -> np.ndarray:
        """Whether the level of each row's point is at most 1. Next to the surface its powers are the C library's, as SQL engines take them."""
        q = self.local(p)
        if self.kind == "sphere":
            return (q[0] * q[0] + q[1] * q[1] + q[2] * q[2]) / (self.r[:, 0] * self.r[:, 0]) <= 1
        norm = self.norm(q)
        if self.kind in ("prism", "ellipsoid"):
            return norm <= 1
        out = norm <= 1
        e, r = self.e, self.r
        for n in np.flatnonzero(np.abs(norm - 1) <= ROOM):
            a, b, c = (float(q[i][n]) / float(r[n, i]) for i in range(3))
            e1, e2, two = float(e[n, 0]), float(e[n, 1]), 2.0
            flat = math.pow(math.pow(a, two), 1 / e2) + math.pow(math.pow(b, two), 1 / e2)
            out[n] = math.pow(flat, e2 / e1) + math.pow(math.pow(c, two), 1 / e1) <= 1
        return out


class Tree:
    """Points in a balanced tree of boxes; level k has 2 ** k of them."""

    def __init__(self, p: np.ndarray):
        n, self.depth = len(p), 0
        while n >> self.depth > LEAF:
            self.depth += 1
        self.order, self.starts, self.low, self.high = np.arange(n), [], [], []
        q = p
        for k in range(self.depth + 1):
            starts = np.array([n * i >> k for i in range((1 << k) + 1)])
            low, high = np.minimum.reduceat(q, starts[:-1], axis=0), np.maximum.reduceat(q, starts[:-1], axis=0)
            self.starts.append(starts)
            self.low.append(low)
            self.high.append(high)
            if k < self.depth:
                node = np.repeat(np.arange(1 << k), np.diff(starts))
                by = np.lexsort((q[np.arange(n), np.argmax(high - low, 1)[node]], node))
                q, self.order = q[by], self.order[by]
        self.points = q


def _open(tree: Tree, k: int, some: Particles, who: np.ndarray, node: np.ndarray):
    """Of pairs of particle and box at level k: those boxes that lie inside, and those that are neither inside nor outside."""
    low, high = tree.low[k][node], tree.high[k][node]
    mine, center, half = some.take(who), low / 2 + high / 2, (high - low) / 2
    norm, wide = mine.norm(mine.local(center)), mine.norm(mine.spread(half))
    room = ROOM + 1e-14 * (np.abs(center).max(1) + np.abs(mine.at).max(1)) / mine.r.min(1)
    wide = wide * (1 + ROOM) + room
    inside = norm + wide <= 1
    return inside, ~inside & ~(norm - wide > 1)


def _leaves(tree: Tree, who: np.ndarray, node: np.ndarray):
    """Each pair's points: (particle, point)."""
    starts = tree.starts[tree.depth]
    size = starts[node + 1] - starts[node]
    first = np.repeat(starts[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.repeat(who, size), first + np.arange(size.sum())


def count_inside(p: np.ndarray, kinds: list[Particles]) -> list[np.ndarray]:
    """For each particle of each kind, how many of the points it holds."""
    counts = [np.zeros(len(some.r), np.int64) for some in kinds]
    if not len(p):
        return counts
    tree = Tree(p)
    for some, n in zip(kinds, counts, strict=True):
        for s in range(0, len(n), BATCH):
            who = np.arange(s, min(s + BATCH, len(n)))
            node = np.zeros(len(who), np.int64)
            for k in range(tree.depth + 1):
                inside, still = _open(tree, k, some, who, node)
                np.add.at(n, who[inside], tree.starts[k][node[inside] + 1] - tree.starts[k][node[inside]])
                who, node = who[still], node[still]
                if k < tree.depth:
                    who, node = np.repeat(who, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            who, at = _leaves(tree, who, node)
            n += np.bincount(who[some.take(who).contain(tree.points[at])], minlength=len(n))
    return counts


def inside_any(p: np.ndarray, kinds: list[Particles]) -> np.ndarray:
    """For each point, whether any particle holds it."""
    if not len(p):
        return np.zeros(0, bool)
    tree = Tree(p)
    held = np.zeros(len(p), bool)
    for some in kinds:
        s, batch = 0, FIRST
        while s < len(some.r):
            done = [np.logical_and.reduceat(held, tree.starts[k][:-1]) for k in range(tree.depth + 1)]
            who = np.arange(s, min(s + batch, len(some.r)))
            s, batch = s + batch, min(2 * batch, BATCH)
            node, marks = np.zeros(len(who), np.int64), np.zeros(len(p) + 1, np.int64)
            for k in range(tree.depth + 1):
                left = ~done[k][node]
                who, node = who[left], node[left]
                inside, still = _open(tree, k, some, who, node)
                new = np.unique(node[inside])
                marks[tree.starts[k][new]] += 1
                marks[tree.starts[k][new + 1]] -= 1
                for below in range(k, tree.depth + 1):  # nobody need look there again
                    done[below].reshape(len(done[k]), -1)[new] = True
                who, node = who[still], node[still]
                if k < tree.depth:
                    who, node = np.repeat(who, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            held |= np.cumsum(marks[:-1]) > 0
            left = ~done[tree.depth][node]
            who, at = _leaves(tree, who[left], node[left])
            left = ~held[at]
            who, at = who[left], at[left]
            held[at[some.take(who).contain(tree.points[at])]] = True
    out = np.empty(len(p), bool)
    out[tree.order] = held
    return out


def particles_of(t: pa.Table) -> tuple[list[np.ndarray], list[Particles]]:
    """Rows of each kind, and those rows. Rows with a null number hold nothing."""
    numbers = np.stack([t[c].to_numpy().astype(float) for c in NUMBERS], 1) if t.num_rows else np.zeros((0, len(NUMBERS)))
    kind = np.array(t["kind"].to_pylist(), dtype=object)
    known = ("sphere", "prism", "ellipsoid")
    rows = [np.flatnonzero(kind == k) for k in known] + [np.flatnonzero(~np.isin(kind.astype(str), known))]
    rows = [r[~np.isnan(numbers[r]).any(1)] for r in rows]
    return rows, [Particles(k, numbers[r]) for k, r in zip((*known, "superellipsoid"), rows, strict=True)]


def coordinates(t: pa.Table, names: tuple[str, str, str]) -> np.ndarray:
    return np.stack([t[c].to_numpy().astype(float) for c in names], 1) if t.num_rows else np.zeros((0, 3))
