"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window as long as an item gets a SimHash fingerprint: the sum of its shingles'
hashed bits, which rolls along the text. Windows that share no shingle at all
with any item of their length have similarity 0 and are passed over; every other
one is looked up. Fingerprints are cut into blocks; items are indexed under every
value a block may have within its part of the radius, so that by the pigeonhole
principle every item within the radius is proposed. Candidates are then verified
by weighted shingle similarity: shingles weigh as often as they occur, the sum of
lesser weights over that of greater. At similarity 0.8 about 10 of 64 bits are
expected to differ, with a deviation of 3, so about one pair in 50,000 at just
0.8 lies beyond the radius of 22 and is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 22, 8
WORD = re.compile(r"[^\W_]+")
#: The index is sent to all tasks, so a benchmark of more words (an item counts as ITEM_WORDS more) is taken in parts of so
#: many, a pass over the documents for each. A part takes under 100 MB: about 300 bytes a word and 2 KB an item.
MOST_WORDS, ITEM_WORDS = 250_000, 40
WINDOWS_AT_ONCE = 4096


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


class Index:
    """Items of a benchmark by shingle and by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.shingle, self.least, self.radius = shingle, least, radius
        self.ids, lists = [], []
        for item, text in items:
            if item is not None and (w := words_of(text)):
                self.ids.append(item)
                lists.append(w)
        self.lengths = [len(w) for w in lists]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in lists for w in x}))}
        self.grams: dict[tuple, int] = {}
        self.items_of: list[set[int]] = []
        self.bags: list[Counter] = []
        for k, w in enumerate(lists):
            codes = [self.vocabulary[x] for x in w]
            bag: Counter = Counter()
            for i in range(max(1, len(codes) - shingle + 1)):
                g = tuple(codes[i : i + shingle])
                at = self.grams.setdefault(g, len(self.grams))
                if at == len(self.items_of):
                    self.items_of.append(set())
                self.items_of[at].add(k)
                bag[at] += 1
            self.bags.append(bag)
        # Items of fewer words than a shingle are one short shingle each.
        self.short = sorted({len(g) for g in self.grams if len(g) < shingle})
        whole = np.array([g for g in self.grams if len(g) == shingle], np.int64).reshape(-1, shingle)
        self.mixed = np.unique(self._mix(list(whole.T)))
        #: by length: items of that length, their fingerprints, and for each block which of them a value proposes
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for span in sorted(set(self.lengths)):
            if span < shingle:
                continue
            items = np.array([k for k, n in enumerate(self.lengths) if n == span])
            sums = np.stack([self._bits([" ".join(lists[k][i : i + shingle]) for i in range(span - shingle + 1)]).sum(0, dtype=np.int64) for k in items])
            prints = self._fold(sums)
            blocks = prints.view(np.uint8).reshape(len(items), BLOCKS)
            near = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :, None] ^ blocks.T[:, None, :]) <= radius // BLOCKS
            self.of_length[span] = items, prints, near

    @staticmethod
    def _mix(columns: list[np.ndarray]) -> np.ndarray:
        """A number for each row of codes, to look most of those up that are no item's shingle; equal rows have equal ones."""
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    @staticmethod
    def _bits(shingles: list[str]) -> np.ndarray:
        """1 or -1 for each of 64 hashed bits (XXH64, seed 42), a row for each shingle's words."""
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(x.encode("utf-8", "surrogatepass"), 42) for x in shingles]), np.uint8)
        return np.unpackbits(h.reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1

    @staticmethod
    def _fold(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()

    def within(self, span: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, place among the items of that length) of all pairs within the radius: blocks propose, counted bits decide."""
        _, own, near = self.of_length[span]
        values = prints.view(np.uint8).reshape(-1, BLOCKS)
        proposed = np.zeros((len(prints), len(own)), bool)
        for b in range(BLOCKS):
            proposed |= near[b][values[:, b]]
        w, k = np.nonzero(proposed)
        close = np.bitwise_count(prints[w] ^ own[k]) <= self.radius
        return w[close], k[close]

    def matches(self, text: str | None) -> dict[int, tuple[float, int]]:
        """By item (its place in the index): the best similarity of a window, and the first word of the first such window."""
        words = words_of(text)
        n = len(words)
        codes = np.array(list(map(self.vocabulary.get, words, repeat(0, n))), np.int64)
        if not n or not codes.any():
            return {}
        best: dict[int, tuple[float, int]] = {}
        known: dict[int, int] = {}  # place -> shingle of the benchmark that starts there
        if n >= self.shingle:
            there, last = codes > 0, n - self.shingle + 1
            run = there[:last].copy()
            for k in range(1, self.shingle):
                run &= there[k : last + k]
            at = np.flatnonzero(run)
            if len(at):
                mixed = self._mix([codes[at + k] for k in range(self.shingle)])
                for i in at[self.mixed[np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)] == mixed].tolist() if len(self.mixed) else ():
                    if (g := self.grams.get(tuple(codes[i : i + self.shingle].tolist()))) is not None:
                        known[i] = g
        for size in self.short:
            for i in np.flatnonzero(np.lib.stride_tricks.sliding_window_view(codes > 0, size).all(1)).tolist() if n >= size else ():
                if (g := self.grams.get(tuple(codes[i : i + size].tolist()))) is not None:
                    for k in self.items_of[g]:
                        best.setdefault(k, (1.0, i))
        if not known:
            return best
        spans: dict[int, list[int]] = {}
        for i, g in known.items():
            for span in {self.lengths[k] for k in self.items_of[g]}:
                spans.setdefault(span, []).append(i)
        last = n - self.shingle + 1
        windows, needed = {}, np.zeros(last + 1, np.int32)
        for span, places in spans.items():
            count = span - self.shingle + 1
            total = min(count, last)  # a text shorter than the item is one window
            edge = np.zeros(last + 1, np.int32)  # starts of windows with any of these places
            at = np.array(places)
            np.add.at(edge, np.maximum(0, at - count + 1), 1)
            np.add.at(edge, np.minimum(at, last - total) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            windows[span] = starts, total
            np.add.at(needed, starts, 1)
            np.add.at(needed, starts + total, -1)
        hashed = np.flatnonzero(np.cumsum(needed[:-1]) > 0)
        bits = self._bits([" ".join(words[i : i + self.shingle]) for i in hashed.tolist()])
        rolled = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)))
        order = sorted(known)
        for span, (starts, total) in windows.items():
            items = self.of_length[span][0]
            for i in range(0, len(starts), WINDOWS_AT_ONCE):
                some = starts[i : i + WINDOWS_AT_ONCE]
                first = np.searchsorted(hashed, some)  # a window's shingles are all hashed, so they stand side by side
                for w, k in zip(*(x.tolist() for x in self.within(span, self._fold(rolled[first + total] - rolled[first]))), strict=True):
                    k, s = int(items[k]), int(some[w])
                    bag = Counter(known[j] for j in order[bisect_left(order, s) : bisect_left(order, s + total)])
                    both = sum((bag & self.bags[k]).values())
                    sim = both / (total + self.bags[k].total() - both)
                    if sim >= self.least and sim > best.get(k, (0.0, 0))[0]:
                        best[k] = (sim, s)
        return best


def _batches(index: Index):
    def run(batches):
        for b in batches:
            rows = [[], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (sim, start) in sorted(index.matches(text).items()):
                    for col, x in zip(rows, (doc, index.ids[k], sim, start), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["id", "item_id", "similarity", "start_word"])

    return run


def indexes(benchmark: DataFrame, **how):
    """Indexes of the benchmark, each of at most MOST_WORDS words (or one item)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    part, words = [], 0
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        words += len(words_of(r["text"])) + ITEM_WORDS
        if words >= MOST_WORDS:
            yield Index(part, **how)
            part, words = [], 0
    yield Index(part, **how)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, item_id, similarity, start_word): documents that hold a passage like an item, with the best window of each.

    Words are runs of letters and digits in lower case, so case, punctuation and
    spacing don't matter. Items of fewer than five words must occur as they are;
    those without a word match nothing. Null texts match nothing; null ids and
    repeated rows are reported like any other. An empty benchmark gives no rows.
    Texts of any length are read whole; of windows with the same similarity the
    first counts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    out = None
    for index in indexes(benchmark, **how):
        found = rows.mapInArrow(_batches(index), "id long, item_id long, similarity double, start_word long")
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a passage like an item; columns and other rows are kept as they are."""
    name = "__decontam"
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    for index in indexes(benchmark, **how):
        def clean(batches, index=index):
            for b in batches:
                texts = pa.compute.struct_field(b.column(0), "text").to_pylist()
                keep = pa.array([not index.matches(t) for t in texts], pa.bool_())
                yield b.filter(keep)

        out = out.mapInArrow(clean, out.schema)
    return out.select(f"{name}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).withColumnRenamed("id", "doc_id")
