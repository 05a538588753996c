"""A causal self-attention model of ids (words and subwords) in numpy: probabilities, gradients and their training steps.

Texts are laid out in blocks of ``BLOCK`` inputs, one text after another, each
beginning a new block. A window is a block and the one before it, so windows
overlap by half, every input is the query of exactly one window, and sees
``BLOCK`` inputs before its block. One layer of attention with a bias for each
pair of places in a window, and a softmax of three levels: ``FAN`` branches, as
many twigs of each, and as many leaves of each of those. The commonest ids have a
leaf of their own; the others share the last leaf of a twig, those of one input
vector in the same twig, and part that leaf's mass by their counts.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from lattica.llm.subwords import flat_places

BLOCK, WIDTH = 16, 16
#: Branches at each level of the softmax.
FAN = 16
#: Input vectors of so many of the most frequent ids start at random, the others at zero.
STARTED = 2048
BLOCKS_AT_ONCE = 1024
#: Blocks of a training step.
BLOCKS_A_STEP = 512


def every(f, *args) -> None:
    """Call f with the first of all args, with the second, and so on: small products take less than a loop around them."""
    deque(map(f, *args), 0)


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of all rows' outer products, some rows at a time: BLAS takes longer over all of them."""
    return sum(a[i : i + 256].T @ b[i : i + 256] for i in range(0, len(a), 256))


class Vocabulary:
    """Leaf of each id, by falling corpus count, so that branches have like mass: leaf = (branch * FAN + twig) * FAN + place."""

    def __init__(self, counts: np.ndarray, inputs: np.ndarray | None = None):
        self.size = len(counts) + 1
        self.end = len(counts)  # ends a text; as an input also starts one
        #: the row of each id's input vector: its own, unless ``inputs`` has some ids share one (the end has its own)
        self.inputs = np.arange(self.size, dtype=np.int32) if inputs is None else np.append(inputs, inputs.max(initial=-1) + 1).astype(np.int32)
        self.rows = int(self.inputs[-1]) + 1
        n = np.append(counts, 0).astype(np.float64)
        n[self.end] = max(1.0, n.sum() / 1000)
        self.order = np.argsort(-n, kind="stable")
        rank = np.empty(self.size, np.int64)
        rank[self.order] = np.arange(self.size)
        alike = (self.inputs.astype(np.int64) * 2654435761 >> 7) % (FAN * FAN)
        twig = np.where(rank < (FAN - 1) * FAN * FAN, rank % (FAN * FAN), alike)
        self.leaf = (twig * FAN + np.minimum(rank // (FAN * FAN), FAN - 1)).astype(np.int16)  # numpy sorts short integers by radix
        mass = n + 0.5
        sums = np.bincount(self.leaf, mass, FAN**3) + 1e-9
        self.within = (np.log(mass) - np.log(sums)[self.leaf]).astype(np.float32)
        #: log of each branch's share, of each twig's in its branch, of each leaf's in its twig
        self.logs = [np.log(x / x.sum(-1, keepdims=True)) for x in (sums.reshape(FAN, -1).sum(1), sums.reshape(FAN, FAN, FAN).sum(2), sums.reshape(FAN * FAN, FAN))]


class Blocks:
    """Texts' inputs x and targets y (-1: none) in blocks, whether a block is its text's first, and whose it is."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, end: int):
        n = counts + 1
        many = -(-n // BLOCK)
        at = flat_places((np.cumsum(many) - many) * BLOCK, n)
        self.x = np.full(int(many.sum()) * BLOCK, end, np.int32)
        self.y = np.full(len(self.x), -1, np.int32)
        begin = np.cumsum(n) - n
        z = np.full(int(n.sum()), end, np.int32)  # each text's ids, and the end behind them
        later = np.ones(len(z), bool)
        later[begin + counts] = False
        z[later] = ids
        self.y[at] = z
        z = np.roll(z, 1)
        z[begin] = end
        self.x[at] = z
        self.x, self.y = self.x.reshape(-1, BLOCK), self.y.reshape(-1, BLOCK)
        self.first = np.zeros(len(self.x), bool)
        self.first[np.cumsum(many) - many] = True
        self.owner = np.repeat(np.arange(len(n)), many)

    def some(self, at: np.ndarray):
        """(inputs of the blocks before and of the blocks themselves in turn, targets, whether first) of blocks in any order."""
        return np.stack((self.x[np.maximum(at - 1, 0)], self.x[at]), 1).reshape(-1, BLOCK), self.y[at], self.first[at]

    def run(self, i: int, j: int, end: int):
        """(inputs of the block before and of blocks i to j, targets, whether first)."""
        before = self.x[i - 1 : i] if i else np.full((1, BLOCK), end, np.int32)
        return np.concatenate((before, self.x[i:j])), self.y[i:j], self.first[i:j]


class Model:
    """Weights are views into one flat vector. e: a vector for each input row, proj: what makes queries, keys, values and the direct path of it."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        self.vocabulary = vocabulary
        w = WIDTH
        levels = {"u0": (1, w + 1, FAN), "u1": (FAN, w + 1, FAN), "u2": (FAN * FAN, w + 1, FAN)}  # the last row of each is its bias
        self.shapes = {"e": (vocabulary.rows, w), "proj": (w, 4 * w), "b": (w,), "place": (BLOCK, 2 * BLOCK), "a": (w, w), **levels}
        self.length = sum(map(math.prod, self.shapes.values()))
        if flat is None:
            rng = np.random.default_rng(7)
            start = {n: np.zeros(x) for n, x in self.shapes.items()}
            start["e"][vocabulary.inputs[vocabulary.order[:STARTED]]] = rng.normal(0, 0.1, (min(STARTED, vocabulary.size), w))
            start["proj"], start["a"] = (rng.normal(0, 1 / math.sqrt(w), self.shapes[n]) for n in ("proj", "a"))
            for n, x in zip(levels, vocabulary.logs, strict=True):
                start[n][:, -1] = x
            flat = np.concatenate([x.ravel() for x in start.values()])
        self.flat = np.asarray(flat, np.float32).copy()
        for n, x in self.parts(self.flat).items():
            setattr(self, n, x)
        self.m, self.s = np.zeros(self.length, np.float32), np.zeros(self.length, np.float32)
        self.steps = 0
        self.shown = np.zeros(vocabulary.rows, np.float32)  # how many steps have moved a row of e
        self.there, self.number = np.zeros(vocabulary.rows, bool), np.zeros(vocabulary.rows, np.intp)  # of a step's input rows, and the places of those it has
        self.plain = False
        i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None]
        self.seen = (j <= i).astype(np.float32)
        self.own = (j >= BLOCK).astype(np.float32)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in self.shapes.values()]).tolist()
        return {n: flat[b - math.prod(s) : b].reshape(s) for (n, s), b in zip(self.shapes.items(), ends, strict=True)}

    def tables(self, e: np.ndarray) -> np.ndarray:
        """Queries (to scale), keys, values and direct paths of subwords with vectors e side by side: one look at an input finds all four."""
        t = e @ self.proj
        t[:, :WIDTH] *= np.float32(1 / math.sqrt(WIDTH))
        t[:, 3 * WIDTH :] += self.b
        return t

    @staticmethod
    def windows(rows: np.ndarray, n: int) -> np.ndarray:
        """n windows of two blocks each: of rows that follow each other (n + 1 of them; overlapping in memory), or of pairs of rows (2 n)."""
        block = rows.strides[0] * BLOCK
        step = 1 if len(rows) == (n + 1) * BLOCK else 2
        return np.lib.stride_tricks.as_strided(rows, (n, 2 * BLOCK, rows.shape[1]), (step * block, *rows.strides))

    def hidden(self, t: np.ndarray, first: np.ndarray):
        """The last layer at each query and, behind it, 1. t: (windows, 2 BLOCK, 4 WIDTH) rows of the table."""
        w, late = WIDTH, slice(BLOCK, None)
        q, k, v = t[:, late, :w], t[:, :, w : 2 * w], t[:, :, 2 * w : 3 * w]
        s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))  # BLAS takes longer over small ones that are turned
        s += self.place
        np.clip(s, -60, 60, out=s)  # so no exponential overflows, nor do all vanish
        np.exp(s, out=s)
        s *= self.seen
        if len(rows := np.flatnonzero(first)):
            s[rows] *= self.own
        over = 1 / (s.reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), np.float32))
        o = (s @ v).reshape(-1, w)
        o *= over
        x = o @ self.a
        x.reshape(len(t), BLOCK, w)[:] += t[:, late, 3 * w :]
        np.tanh(x, out=x)
        h = np.ones((len(o), w + 1), np.float32)
        h[:, :w] = x
        return h, (q, k, v, s, over, o, x)

    def log_probs(self, h: np.ndarray, y: np.ndarray, back: bool = False, there: np.ndarray | None = None):
        """Natural log of the targets' probabilities but for their share of a leaf; with ``back`` also gradients of the negative sum, by h (but for its last column; zero in rows that aren't ``there``) and by weights. Targets are those of the rows ``there`` of h, or of all."""
        leaf = self.vocabulary.leaf[y]
        order = np.argsort(leaf, kind="stable")
        leaf = leaf[order].astype(np.int32)
        who, n = order if there is None else there[order], len(order)
        ends = np.searchsorted(leaf, np.arange(0, FAN**3 + 1, FAN)).tolist()
        runs = [slice(i, j) for i, j in zip(ends, ends[1:], strict=False)]  # targets of a twig follow each other
        u, rows, z = self.levels(), h.take(who, 0), np.empty((n, 3 * FAN), np.float32)
        of_rows, of_z = [rows[run] for run in runs], [z[run] for run in runs]
        every(np.dot, of_rows, u, of_z)
        np.clip(z, -60, 60, out=z)
        row = np.arange(0, 3 * FAN * n, 3 * FAN)
        at = [row + (leaf >> 8), row + (FAN + (leaf >> 4 & FAN - 1)), row + (2 * FAN + (leaf & FAN - 1))]
        flat = z.ravel()
        mine = flat.take(at[0]) + flat.take(at[1]) + flat.take(at[2])
        np.exp(z, out=z)
        z3 = z.reshape(-1, FAN)
        total = z3 @ np.ones((FAN, 1), np.float32)
        out = np.empty(n, np.float32)
        out[order] = mine - (np.log(total).reshape(-1, 3) @ np.ones((3, 1), np.float32)).ravel()  # numpy sums short rows slowly
        if not back:
            return out
        z3 *= 1 / total
        for a in at:
            flat[a] -= 1
        du, d = np.empty_like(u), np.empty((n + 1, WIDTH), np.float32)
        d[n] = 0  # what rows without a target have
        every(np.dot, [r.T for r in of_rows], of_z, du)
        every(np.dot, of_z, u[:, :WIDTH].transpose(0, 2, 1), [d[run] for run in runs])
        place = np.full(len(h), n)
        place[who] = np.arange(n)
        by_branch = du.reshape(FAN, FAN, WIDTH + 1, 3 * FAN).sum(1)
        return out, d.take(place, 0), {"u0": by_branch[:, :, :FAN].sum(0, keepdims=True), "u1": by_branch[:, :, FAN : 2 * FAN], "u2": du[:, :, 2 * FAN :]}

    def levels(self) -> np.ndarray:
        """Of each twig the weights of its three levels side by side."""
        u = np.empty((FAN, FAN, WIDTH + 1, 3 * FAN), np.float32)
        u[..., :FAN], u[..., FAN : 2 * FAN], u[..., 2 * FAN :] = self.u0, self.u1[:, None], self.u2.reshape(FAN, FAN, WIDTH + 1, FAN)
        return u.reshape(FAN * FAN, WIDTH + 1, 3 * FAN)

    def gradient(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, e: np.ndarray, t: np.ndarray):
        """The gradient of the summed log loss of targets y: by name, but for ``e``, of which rows and their parts (one column each) are given. x numbers rows of e and of its table t."""
        w, n = WIDTH, len(y)
        rows = t.take(x.ravel(), 0)
        h, (q, k, v, s, over, o, last) = self.hidden(self.windows(rows, n), first)
        there = np.flatnonzero(y.ravel() >= 0)
        _, dh, g = self.log_probs(h, y.ravel()[there], True, there)
        last *= last
        dh *= np.subtract(1, last, out=last)
        g["a"], g["b"] = outer(o, dh), np.ones(len(dh), np.float32) @ dh
        do = dh @ self.a.T
        inner = (do * o) @ np.ones((w, 1), np.float32)
        do3 = do.reshape(n, BLOCK, w)
        ds = do3 @ np.ascontiguousarray(v.transpose(0, 2, 1))
        s2, ds2 = s.reshape(-1, 2 * BLOCK), ds.reshape(-1, 2 * BLOCK)
        s2 *= over
        ds2 -= inner
        ds2 *= s2
        g["place"] = ds.sum(0)
        drows = np.empty_like(rows).reshape(-1, BLOCK, 4 * w)
        run = len(drows) == n + 1
        early, late = (drows[:-1], drows[1:]) if run else (drows[::2], drows[1::2])
        (drows[:1] if run else early)[:] = 0  # blocks that are no window's last
        dkv = np.empty((n, 2 * BLOCK, 2 * w), np.float32)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :w])
        np.matmul(s.transpose(0, 2, 1), do3, out=dkv[:, :, w:])
        late[:, :, w : 3 * w] = dkv[:, BLOCK:]
        early[:, :, w : 3 * w] += dkv[:, :BLOCK]
        np.matmul(ds, k, out=late[:, :, :w])
        late[:, :, 3 * w :] = dh.reshape(n, BLOCK, w)
        dt, who, scale = drows.reshape(-1, 4 * w), x.ravel(), np.ones(4 * w, np.float32)
        scale[:w] = 1 / math.sqrt(w)  # of queries
        g["proj"] = outer(e.take(who, 0), dt) * scale
        return g, who, (self.proj * scale) @ dt.T

    @staticmethod
    def by_row(who: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        """The sums of all parts of each of n rows."""
        return np.stack([np.bincount(who, p, n) for p in parts], 1)

    def total_gradient(self, blocks: Blocks, grad: np.ndarray) -> int:
        """Add the gradient of all targets of the blocks to a flat one; gives how many there are."""
        out, t, end = self.parts(grad), self.tables(self.e), self.vocabulary.inputs[-1]
        for i in range(0, len(blocks.x), BLOCKS_AT_ONCE):
            g, who, parts = self.gradient(*blocks.run(i, min(len(blocks.x), i + BLOCKS_AT_ONCE), end), self.e, t)
            for name, a in g.items():
                out[name] += a
            out["e"] += self.by_row(who, parts, len(self.e))
        return int((blocks.y >= 0).sum())

    def step(self, grad: np.ndarray, rate: float) -> None:
        """A step of Adam along the mean gradient; of a plain model, along what is given, as it is."""
        if self.plain:
            self.flat -= np.float32(rate) * grad
            return
        self.steps += 1
        self.m = 0.9 * self.m + np.float32(0.1) * grad
        self.s = 0.99 * self.s + np.float32(0.01) * grad * grad
        self.flat -= (rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.s / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, rate: float) -> int:
        """A step of Adam on the mean log loss of some windows; gives how many targets they have. Input rows that aren't there stay as they are, and so do their moments."""
        n, tail = int((y >= 0).sum()), self.e.size
        self.there[x] = True
        used = np.flatnonzero(self.there)
        self.there[used] = False
        self.number[used] = np.arange(len(used))
        e = self.e.take(used, 0)
        g, who, parts = self.gradient(self.number[x], y, first, e, self.tables(e))
        self.steps += 1
        self.shown[used] += 1
        m, s = (a[:tail].reshape(self.e.shape) for a in (self.m, self.s))
        own, rest = self.by_row(who, parts, len(e)).astype(np.float32), np.concatenate([g[name].ravel() for name in self.shapes if name != "e"])
        a, b = m.take(used, 0), s.take(used, 0)
        e -= self.moved(own, a, b, self.shown[used][:, None], n, rate)
        self.e[used], m[used], s[used] = e, a, b
        self.flat[tail:] -= self.moved(rest, self.m[tail:], self.s[tail:], np.float32(self.steps), n, rate)
        return n

    @staticmethod
    def moved(g: np.ndarray, m: np.ndarray, s: np.ndarray, steps, n: int, rate: float) -> np.ndarray:
        """What Adam takes from weights whose loss, summed over n targets, has the gradient g (which is overwritten); the moments m and s are brought up to this step."""
        g *= np.float32(0.1 / max(1, n))
        m *= np.float32(0.9)
        m += g
        g *= g  # a hundredth of the mean gradient's square
        s *= np.float32(0.99)
        s += g
        np.divide(s, 1 - np.float32(0.99) ** steps, out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        g *= (1 - np.float32(0.9) ** steps) / np.float32(rate)
        return np.divide(m, g, out=g)

    def learn(self, blocks: Blocks, rate: float) -> int:
        """Steps on all blocks, about BLOCKS_A_STEP that follow each other at a time; gives how many targets they have."""
        many = -(-len(blocks.x) // BLOCKS_A_STEP)
        edges = [k * len(blocks.x) // many for k in range(many + 1)] if many else []
        return sum(self.train(*blocks.run(i, j, self.vocabulary.inputs[-1]), rate) for i, j in zip(edges, edges[1:], strict=False))

    def scores(self, blocks: Blocks, t: np.ndarray, texts: int) -> np.ndarray:
        """log10 probability of each text, its end included."""
        out, end = np.zeros(texts), self.vocabulary.inputs[-1]
        for i in range(0, len(blocks.x), BLOCKS_AT_ONCE):
            j = min(len(blocks.x), i + BLOCKS_AT_ONCE)
            x, y, first = blocks.run(i, j, end)
            h, _ = self.hidden(self.windows(t.take(x.ravel(), 0), j - i), first)
            y = y.ravel()
            at = np.flatnonzero(y >= 0)
            lp = np.zeros(len(y))
            lp[at] = self.log_probs(h, y[at], there=at) + self.vocabulary.within[y[at]]
            out += np.bincount(blocks.owner[i:j], lp.reshape(-1, BLOCK).sum(1), texts)
        return out / math.log(10)
