"""Packing into sequences: Martello and Toth's dominance reduction, then best fit.

What matters of a piece is its length, so the instance is the number of pieces
of each length: at most ``capacity`` numbers, however many documents there are.
The driver reduces that instance (sets of lengths that provably dominate all
others are fixed for good, as often as they occur) and packs what remains by
best fit in falling order of length. The result is a short list of runs: so many
pieces of one length go, in order, to consecutive sequences at one offset. The
pieces are then numbered within their length, by a distributed sort, and look up
their run.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut
from lattica.llm.sharding import row_numbers
from lattica.llm.subwords import evenly, split_words, tokenizer_path, word_ids

CAPACITY = 2048
END_ID = 0


def dominating(counts: np.ndarray, j: int) -> tuple[int, ...] | None:
    """A set with an item of size j that dominates every feasible set with one, or None.

    counts[s]: how many items of size s are left. A set dominates another if the
    other's items can be parted into groups none of which is larger than an item
    of the first that stands for it: some optimal packing then has the first.
    """
    capacity = len(counts) - 1
    left = counts.copy()
    left[j] -= 1
    room = capacity - j
    sizes = np.flatnonzero(left)
    sizes = sizes[sizes <= room]
    if not len(sizes):
        return (j,)
    i = int(sizes[-1])
    smallest = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
    if i == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (j, i)  # fills the rest, or one more is all that fits, and i is the largest
    if len(smallest) == 3 and smallest.sum() <= room:
        return None
    # At most two more fit. The largest sum of two, for every size as the lesser.
    d = sizes[2 * sizes <= room]
    c = sizes[np.searchsorted(sizes, room - d, "right") - 1]
    pairs = (c > d) | (left[d] > 1)
    c, d = c[pairs], d[pairs]
    if not len(c) or (c + d).max() <= i:
        return (j, i)
    with_i = sizes[sizes <= room - i]
    with_i = with_i[(with_i != i) | (left[i] > 1)]
    if not len(with_i):
        return None
    b = int(with_i[-1])
    return None if ((d > b) & (c + d > i)).any() else (j, i, b)


def runs(counts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """(length, first rank, how many, first sequence, offset) runs, sequences used, and pieces fixed by the reduction."""
    counts = counts.copy()
    capacity = len(counts) - 1
    out: list[tuple[int, int, int, int, int]] = []
    rank: Counter[int] = Counter()
    sequences = fixed = 0

    def put(size: int, many: int, first: int, offset: int) -> None:
        out.append((size, rank[size], many, first, offset))
        rank[size] += many
        counts[size] -= many

    again = True
    while again:
        again = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (chosen := dominating(counts, j)):
                times = min(int(counts[s]) // k for s, k in Counter(chosen).items())
                offset = 0
                for s in chosen:
                    put(s, times, sequences, offset)
                    offset += s
                sequences, fixed, again = sequences + times, fixed + times * len(chosen), True
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first sequence, how many) by room left
    for j in np.flatnonzero(counts)[::-1].tolist():
        while counts[j]:
            rooms = [r for r, x in open_.items() if r >= j and x]
            if rooms:
                room = min(rooms)
                first, many = open_[room].pop()
            else:
                room, first = capacity, sequences
                many = -(-int(counts[j]) // (capacity // j))
                sequences += many
            each = room // j  # best fit returns to a bin while it has room for the same size
            full = min(many, int(counts[j]) // each)
            for k in range(each if full else 0):
                put(j, full, first, capacity - room + k * j)
            if full:
                open_[room - each * j].append((first, full))
            if (rest := int(counts[j])) and full < many:
                for k in range(rest):
                    put(j, 1, first + full, capacity - room + k * j)
                open_[room - rest * j].append((first + full, 1))
                full += 1
            if full < many:
                open_[room].append((first + full, many - full))
    return out, sequences, fixed


def _piece_batches(path: str, capacity: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        encoder = word_ids(path)
        for b in evenly(batches, 1):
            ids, n = encoder.ids(*split_words(b.column(1)))
            data, first = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(n) - n
            many = -(-(n + 1) // capacity)  # pieces of each document, whose end counts as well
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[row] + 1 - start, capacity)
            a = first[row] + start
            z = a + np.minimum(length, n[row] - start)
            last = piece == many[row] - 1
            crc = [zlib.crc32(end, zlib.crc32(data[4 * i : 4 * j])) if e else zlib.crc32(data[4 * i : 4 * j]) for i, j, e in zip(a.tolist(), z.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place_batches(starts: np.ndarray, sequences: np.ndarray, offsets: np.ndarray):
    def run(batches):
        for b in batches:
            r = b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, r, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequences[at] + r - starts[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (a null text has none) and END_ID; only those of
    over ``capacity`` ids are cut. Null ids and repeated rows are packed like any
    other; an empty table gives no pieces.
    """
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = cut(text.mapInArrow(_piece_batches(path, capacity), schema))
    numbered, _ = row_numbers(pieces, ["length", "doc_id", "piece", "ids_crc32"])
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most a row for each length
        counts[r["length"]] = r["count"]
    found, _, _ = runs(counts)
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    table = np.array(sorted((before[s] + rank, first, offset) for s, rank, _, first, offset in found), np.int64).reshape(-1, 3)
    placed = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "row_number")
    return placed.mapInArrow(_place_batches(*table.T.copy()), f"{schema}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
