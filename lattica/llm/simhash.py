"""SimHash near-duplicates by tiled exact comparison.

Every pair of distinct fingerprints is compared, by exclusive-or and bit count
in numpy, except pairs of tiles that population counts rule out: two
fingerprints within the radius differ by no more than the radius in their
population counts, summed over any division of the bits into parts. Tiles are
first those of equal counts in both halves (grouped in steps of radius + 1, to
deal them to tasks), then, where enough rows fall together, of 4, 8 and 16 parts.

Cost: the compared share of pairs still grows with the square of the number of
distinct fingerprints; each is sent to about 20 tasks, and a task holds one
bounded home tile and streams the rest past it. A task returns a spanning
forest of its links, never all pairs, so a large group of copies costs a row
each. Exact copies share one fingerprint and count once.

``deduplicate`` takes these links, at a wide radius, as candidates only: within
each group of candidates the sets of shingles themselves are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import HOT_SHARE, cut, lookup

SHINGLES_AT_ONCE = 1 << 16
#: A task's home tile: at most so many fingerprints, at least the other (unless there are fewer).
MOST_HOME, LEAST_HOME = 1 << 18, 1 << 8
HOMES = 64
PAIRS_AT_ONCE = 1 << 18
#: A group of candidates is compared in parts of about so many shingles and texts, every two parts in a task.
SHINGLES_A_PART, TEXTS_A_PART = 1 << 19, 1 << 9


def fingerprint(text: bytes | None, shingle_words: int = 4, bits: int = 64) -> tuple[bytes, int]:
    """(fingerprint as big-endian bytes, number of shingles) of a UTF-8 text.

    A-Z are lower-cased, words parted at ASCII white space; shingles count as
    often as they occur. Fewer words than a shingle has: one shingle of all. No
    word (null, empty, blank): fingerprint zero, no shingle. 64 bits: XXH64,
    seed 42; 128 bits: XXH3-128, seed 42.
    """
    words = text.lower().split() if text else []
    if not words:
        return bytes(bits // 8), 0
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    ones = np.zeros(bits, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        j = i + SHINGLES_AT_ONCE
        h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i:j], stops[i:j], strict=True)]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, bits // 8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes(), n


def _fingerprint_batches(shingle_words: int, bits: int):
    def run(batches):
        for b in batches:
            got = [fingerprint(t, shingle_words, bits) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[: bits // 8 - 8].hex() for f, _ in got]), pa.array([f[-8:].hex() for f, _ in got]), pa.array([n for _, n in got], pa.int64())],
                ["id", "hi", "lo", "n"],
            )

    return run


# ---- comparison within a task ------------------------------------------------


def part_counts(hi: np.ndarray, lo: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Population counts of each of so many equal parts of the fingerprints, a row for each."""
    words = [lo] if bits == 64 else [hi, lo]
    width = bits // parts
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(2**64 - 1)
    return np.stack([np.bitwise_count((w >> np.uint64(s)) & mask) for w in words for s in range(0, 64, width)], 1).astype(np.int16)


class Home:
    """A home tile, its components so far, and the comparison of others with it."""

    def __init__(self, hi, lo, n, bits: int, radius: int, ratio: float):
        self.hi, self.lo, self.n = hi, lo, n
        self.bits, self.radius, self.ratio = bits, radius, ratio
        self.root = np.arange(len(lo))

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Make u[i] and v[i] members of the same component, for every i."""
        root = self.root
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]

    def pairs(self, hi, lo, n):
        """Yield (home index, other index) arrays of all pairs within the radius."""
        yield from self._compare(np.arange(len(self.lo)), np.arange(len(lo)), hi, lo, n, 2)

    def _compare(self, a, b, hi, lo, n, parts):
        if not len(a) or not len(b):
            return
        if parts <= 16 and len(a) * len(b) > PAIRS_AT_ONCE:
            ka, ia = np.unique(part_counts(self.hi[a], self.lo[a], self.bits, parts), axis=0, return_inverse=True)
            kb, ib = np.unique(part_counts(hi[b], lo[b], self.bits, parts), axis=0, return_inverse=True)
            if len(a) * len(b) >= (PAIRS_AT_ONCE >> 4) * len(ka) * len(kb):
                oa, ob = np.argsort(ia.ravel(), kind="stable"), np.argsort(ib.ravel(), kind="stable")
                ca, cb = np.cumsum(np.bincount(ia.ravel()))[:-1], np.cumsum(np.bincount(ib.ravel()))[:-1]
                tiles_a, tiles_b = np.split(a[oa], ca), np.split(b[ob], cb)
                for i, row in enumerate(ka):  # tile pairs whose counts differ beyond the radius are skipped
                    for j in np.flatnonzero(np.abs(kb - row).sum(1) <= self.radius):
                        yield from self._compare(tiles_a[i], tiles_b[j], hi, lo, n, 2 * parts)
                return
        step = max(1, PAIRS_AT_ONCE // len(b))
        lo_b, hi_b = lo[b], hi[b]
        for s in range(0, len(a), step):
            c = a[s : s + step]
            apart = np.bitwise_count(self.lo[c, None] ^ lo_b)
            if self.bits == 128:
                apart += np.bitwise_count(self.hi[c, None] ^ hi_b)
            hit = np.flatnonzero(apart <= self.radius)
            if len(hit):
                x, y = c[hit // len(b)], b[hit % len(b)]
                if self.ratio:
                    p, q = self.n[x], n[y]
                    near = np.minimum(p, q) >= self.ratio * np.maximum(p, q)
                    x, y = x[near], y[near]
                yield x, y


def _names(hi, lo, n, bits: int, ratio: float) -> list[str]:
    """Node names: the fingerprint's hex digits, and the shingle count where it matters."""
    out = [f"{x:016x}" for x in lo.tolist()] if bits == 64 else [f"{h:016x}{x:016x}" for h, x in zip(hi.tolist(), lo.tolist(), strict=True)]
    return [f"{x}:{k}" for x, k in zip(out, n.tolist(), strict=True)] if ratio else out


def _link_batches(bits: int, radius: int, ratio: float):
    def edges(u: list[str], p: list[str]):
        both = [(max(x), min(x)) for x in zip(u, p, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string())], ["u", "p"])

    def own(home: Home):
        for x, y in home.pairs(home.hi, home.lo, home.n):
            home.join(x, y)

    def last(home: Home):
        other = np.flatnonzero(home.root != np.arange(len(home.root)))
        if len(other):
            r = home.root[other]
            yield edges(_names(home.hi[other], home.lo[other], home.n[other], bits, ratio), _names(home.hi[r], home.lo[r], home.n[r], bits, ratio))

    def run(batches):
        task, parts, home = None, [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            keys, kinds = cols[0], cols[1]
            turn = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != task:
                    if parts:
                        home = Home(*map(np.concatenate, zip(*parts, strict=True)), bits, radius, ratio)
                        own(home)
                    if home:
                        yield from last(home)
                    task, parts, home = keys[a], [], None
                rows = [cols[2][a:b].view(np.uint64), cols[3][a:b].view(np.uint64), cols[4][a:b]]
                if kinds[a] == 0:
                    parts.append(rows)
                    continue
                if home is None:
                    home = Home(*map(np.concatenate, zip(*parts, strict=True)), bits, radius, ratio)
                    parts = []
                    own(home)
                met = np.full(b - a, -1)
                for x, y in home.pairs(*rows):
                    new = met[y] < 0
                    met[y[new]] = x[new]
                    home.join(met[y], x)
                other = np.flatnonzero(met >= 0)
                if len(other):
                    m = met[other]
                    yield edges(_names(rows[0][other], rows[1][other], rows[2][other], bits, ratio), _names(home.hi[m], home.lo[m], home.n[m], bits, ratio))
        if parts:
            home = Home(*map(np.concatenate, zip(*parts, strict=True)), bits, radius, ratio)
            own(home)
        if home:
            yield from last(home)

    return run


def _spread_batches(homes: dict[int, int], near: dict[int, list[int]]):
    """Send each node to its home chunk (kind 0) and to every chunk it must be compared with (kind 1)."""

    def run(batches):
        for b in batches:
            tile, hi, lo, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for t in np.unique(tile).tolist():
                at = np.flatnonzero(tile == t)
                mixed = lo[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                chunk = (mixed % np.uint64(homes[t])).astype(np.int64)
                out = [(t << 20 | chunk, 0, at)]
                out += [(np.full(int((chunk > c).sum()), t << 20 | c), 1, at[chunk > c]) for c in range(homes[t] - 1)]
                out += [(np.full(len(at), u << 20 | c), 1, at) for u in near[t] for c in range(homes[u])]
                for task, kind, x in out:
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(np.full(len(x), kind, np.int8)), pa.array(hi[x]), pa.array(lo[x]), pa.array(n[x])], ["task", "kind", "hi", "lo", "n"])

    return run


def links(nodes: DataFrame, bits: int, radius: int, ratio: float) -> DataFrame:
    """Links (u, p), u > p, that connect what lies within the radius; nodes: distinct (hi, lo, n), as longs."""
    spark = nodes.sparkSession
    wide = radius + 1
    bucket = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -math.log(ratio)).cast("long") if ratio else F.lit(0).cast("long")
    first, second = (F.col("hi"), F.col("lo")) if bits == 128 else (F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)))
    tile = (bucket * 10_000 + F.floor(F.bit_count(first) / wide) * 100 + F.floor(F.bit_count(second) / wide)).cast("long")
    nodes = nodes.select(tile.alias("tile"), "hi", "lo", "n")
    counts = {r["tile"]: r["count"] for r in nodes.groupBy("tile").count().collect()}  # at most (64 / wide + 1) ** 2 tiles for each step of size
    total = sum(counts.values())
    chunk = min(MOST_HOME, max(LEAST_HOME, -(-total // HOMES)))
    homes = {t: -(-n // chunk) for t, n in counts.items()}
    parts = lambda t: np.array((t // 10_000, t // 100 % 100, t % 100))
    near = {t: [u for u in counts if u < t and np.abs(parts(u) - parts(t)).max() <= 1] for t in counts}
    tasks = max(1, sum(homes.values()))
    spread = nodes.mapInArrow(_spread_batches(homes, near), "task long, kind byte, hi long, lo long, n long")
    dealt = spread.repartition(min(tasks, 4000), "task").sortWithinPartitions("task", "kind")
    return dealt.mapInArrow(_link_batches(bits, radius, ratio), "u string, p string") if total else spark.createDataFrame([], "u string, p string")


def components(edges: DataFrame) -> DataFrame:
    """(u, p): each linked node but the least of its component, and that least one.

    Rounds of small-star (a node and its lower neighbours join their least) and
    of pointer jumping, each written to the shared folder, until none moves.
    """
    e = cut(edges.distinct().withColumn("moved", F.lit(True)))
    while e.agg(F.max("moved")).first()[0]:
        least = e.groupBy("u").agg(F.min("p").alias("m"))
        star = least.select("u", F.col("m").alias("p"), F.lit(False).alias("moved")).unionByName(
            e.join(least, "u").filter("p > m").select(F.col("p").alias("u"), F.col("m").alias("p"), F.lit(True).alias("moved"))
        )
        star = cut(star.groupBy("u", "p").agg(F.max("moved").alias("moved")))
        up = star.groupBy(F.col("u").alias("p")).agg(F.min("p").alias("pp"))
        jumped = lookup(star, up, "p").select("u", F.coalesce("pp", "p").alias("p"), (F.col("moved") | F.col("pp").isNotNull()).alias("moved"))
        e = cut(jumped.groupBy("u", "p").agg(F.max("moved").alias("moved")))
    return e.select("u", "p")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 4, bits: int = 64, radius: int = 4, size_ratio: float = 0.0) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Fingerprints within ``radius`` bits are linked, and with ``size_ratio`` only
    if the lesser of their shingle counts is at least that share of the other;
    component_id is the least id reachable, itself included. Rows repeat as
    they do in docs; a null id stays null and names no component (which is null
    only if all its ids are). Null, empty and blank texts have fingerprint zero.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = text.mapInArrow(_fingerprint_batches(shingle_words, bits), "id long, hi string, lo string, n long")
    name = F.concat_ws(":", F.concat("hi", "lo"), F.col("n")) if size_ratio else F.concat("hi", "lo")
    rows = cut(prints.select("id", name.alias("node"), F.concat("hi", "lo").alias("fingerprint"), "hi", "lo", (F.col("n") if size_ratio else F.lit(0).cast("long")).alias("n")))
    nodes = cut(rows.groupBy("node", "hi", "lo", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    as_long = lambda c: F.conv(F.when(F.col(c) == "", "0").otherwise(F.col(c)), 16, -10).cast("long")
    labels = components(links(nodes.select(as_long("hi").alias("hi"), as_long("lo").alias("lo"), "n"), bits, radius, size_ratio))
    linked = cut(labels.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(labels.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()).join(nodes.select("node", "least"), "node"))
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    mine = lookup(linked, of_root, "root").select("node", "component_id")
    every = cut(nodes.join(mine, "node", "left").select("node", "rows", F.coalesce("component_id", "least").alias("component_id")))
    total = every.agg(F.sum("rows")).first()[0] or 0
    hot = every.filter(F.col("rows") > HOT_SHARE * total).select("node")
    return lookup(rows, every.drop("rows"), "node", hot).select("id", "fingerprint", "component_id")


def shingle_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """Sorted 128-bit hashes (XXH3, seed 42; a row of two numbers each) of the distinct shingles, as ``fingerprint`` counts them."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    distinct = sorted({xxhash.xxh3_128_digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)})
    return np.frombuffer(b"".join(distinct), ">u8").astype(np.uint64).reshape(-1, 2)


def _set_batches(shingle_words: int):
    """Of each text a name of its set of shingles, the 128-bit fingerprint of the set, and how many there are."""

    def run(batches):
        for b in batches:
            names, prints, n = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_set(t, shingle_words)
                ones = np.zeros(128, np.int64)
                for i in range(0, len(h), SHINGLES_AT_ONCE):
                    ones += np.unpackbits(h[i : i + SHINGLES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.uint32)
                names.append(xxhash.xxh3_128_hexdigest(h.tobytes(), 42))
                prints.append(np.packbits(2 * ones > len(h)).view(">u8").astype(np.int64))
                n.append(len(h))
            wide = np.array(prints, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(wide[:, 0]), pa.array(wide[:, 1]), pa.array(n, pa.int64())], ["id", "node", "hi", "lo", "n"])

    return run


def _hash_batches(shingle_words: int):
    """Of each text the first halves of its shingles' hashes."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([np.unique(shingle_set(t, shingle_words)[:, 0]).tobytes() for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())], [*b.schema.names[:-1], "set"])

    return run


def set_links(ids: list[int], sets: list[np.ndarray], first: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, (greater id, lesser id), of pairs of sets of at least that similarity.

    The first so many sets are one part and the others another: only pairs of
    one with the other are compared; all pairs, if there is no other.
    """
    if not sets or not (size := np.array([len(x) for x in sets])).any():
        return []
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    start = np.concatenate(([0], np.cumsum(size)))
    root, out = np.arange(len(sets)), []
    mark = np.zeros(int(code.max()) + 1, bool)
    for i in range(first if first < len(sets) else 1, len(sets)):
        earlier = np.arange(min(i, first))
        n = size[earlier]
        left = earlier[(np.minimum(n, size[i]) + 1e-9 >= similarity * np.maximum(n, size[i])) & (n > 0)]
        own = code[start[i] : start[i + 1]]
        mark[own] = True
        while len(left := left[root[left] != root[i]]):  # pairs connected already need no look
            some, left = left[:8], left[8:]
            for j in some.tolist():
                if root[j] == root[i]:
                    continue
                both = int(np.count_nonzero(mark[code[start[j] : start[j + 1]]]))
                if both + 1e-9 >= similarity * (size[i] + size[j] - both):
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        mark[own] = False
    return out


def _verify_batches(similarity: float):
    """Links of tasks: rows (label, a, b, part, id, set), sorted by the first four."""

    def run(batches):
        task, ids, sets, first = None, [], [], 0

        def done():
            got = set_links(ids, sets, first, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["u", "p"])

        for batch in batches:
            for label, a, b, part, i, x in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (label, a, b) != task:
                    if task:
                        yield done()
                    task, ids, sets, first = (label, a, b), [], [], 0
                ids.append(i)
                sets.append(np.frombuffer(x, np.uint64))
                first += part == a
        if task:
            yield done()

    return run


def deduplicate(docs: DataFrame, *, shingle_words: int = 5, radius: int = 32, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each component the first row stays.

    Two texts are near-duplicates if their sets of shingles have a similarity J
    (common ones by all) of at least ``similarity``; components are of links
    verified so, on the sets (by hashes). Candidates are groups connected by
    128-bit fingerprints of the sets, within ``radius`` bits and with counts of
    shingles in that ratio: at J = 0.8 the angle stands for 19 bits, and 32 are
    three deviations more. Texts with the same set need no fingerprint. The row
    number in the input (a scan of written files) identifies rows, so null or
    repeated ids do no harm; exact repeats go. Texts without a word are copies
    of each other: one stays. Columns are kept.
    """
    rid = "__simhash_row"
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    binary = numbered.select(rid, F.col("text").cast("binary").alias("text"))
    rows = cut(binary.mapInArrow(_set_batches(shingle_words), "id long, node string, hi long, lo long, n long"))
    nodes = cut(rows.groupBy("node", "hi", "lo", "n").agg(F.min("id").alias("least")))
    # a set of fewer shingles than this is near to no other
    able = nodes.filter(F.col("n") >= math.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else nodes.limit(0)
    able = able.withColumn("print", F.concat(F.lower(F.lpad(F.hex("hi"), 16, "0")), F.lower(F.lpad(F.hex("lo"), 16, "0")), F.lit(":"), F.col("n")))
    found = components(links(able.select("hi", "lo", "n").distinct(), 128, radius, similarity))
    label = found.select(F.col("u").alias("print"), F.col("p").alias("label"))
    labelled = cut(lookup(able.select("least", "n", "print"), label, "print").select("least", "n", F.coalesce("label", "print").alias("label")))
    parts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("all")).filter("texts > 1")
    parts = parts.select("label", F.greatest(F.ceil(F.col("all") / SHINGLES_A_PART), F.ceil(F.col("texts") / TEXTS_A_PART)).cast("long").alias("parts"))
    members = lookup(labelled, parts, "label").filter("parts IS NOT NULL").select(F.col("least").alias(rid), "label", "parts", F.pmod(F.xxhash64("least"), F.col("parts")).alias("part"))
    texts = binary.join(members, rid).select(rid, "label", "parts", "part", "text")
    sets = cut(texts.mapInArrow(_hash_batches(shingle_words), f"{rid} long, label string, parts long, part long, set binary"))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("label", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", F.col(rid).alias("id"), "set")
    dealt = dealt.repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "part", "id")
    near = components(dealt.mapInArrow(_verify_batches(similarity), "u long, p long"))
    kept = nodes.select(F.col("least").alias("id")).join(near.select(F.col("u").alias("id")), "id", "left_anti")
    gone = cut(rows.select("id").join(kept, "id", "left_anti").select(F.col("id").alias(rid)))
    return numbered.join(gone, rid, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
