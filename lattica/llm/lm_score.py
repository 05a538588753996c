"""Language-model scores: a causal self-attention model on words and subwords, and a word baseline.

The model (see ``attention``) is trained in numpy. Words that are common, and occur
``UNIT_LEAST`` times or more in training documents, are an id each; any other word
is spelled by the ids of its subwords, so those learn from training documents' rare
words what unseen words look like. The softmax's branches, their first biases and
the shares within a leaf come from counts over all training documents; nothing else
is fitted before the first round.

All training documents are dealt to rounds, and those of a round to cells of about
``WORDS_A_CELL`` words, by a hash. From a round's weights each cell takes steps on
every window of all its documents, in the order of their hashes; the mean of what
the cells have moved, weighed by their targets, makes the weights of the next round.
So the weights follow from the documents and not from how files or partitions hold
them. Texts are scored in overlapping windows, batched and masked, each id once.

The baseline needs the corpus count of each word. The ``FREQUENT`` commonest
words are broadcast; the others, each a small part of all, are joined, a row for
each document and word.
"""

from __future__ import annotations

import ctypes
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.attention import Blocks, Model, Vocabulary
from lattica.llm.common import cut, delete_at_exit, shared_dir
from lattica.llm.subwords import evenly, split_words, spread, tokenizer_path, word_ids

#: At most so many words are broadcast, none of them longer than LONGEST bytes: 48 MB at most.
FREQUENT, LONGEST = 1 << 19, 64
#: A common word that training documents have so often is an id; one that they have once stands for those they lack.
UNIT_LEAST = 2
#: So many of these have an input vector of their own, any other has that of its last subword.
OWN_INPUTS = 4096
#: Rounds at the first rate, and those after them, whose rate falls.
START_STEPS, START_RATE = 4, 0.04
ROUNDS, ROUND_RATE = 16, 0.04
WORDS_A_CELL = 1 << 19
#: A cell's texts are laid out in blocks so many bytes at a time.
LEARNT_AT_ONCE = 1 << 20
#: Texts of about so many bytes of ids are scored at once.
IDS_AT_ONCE = 1 << 21
#: Texts that are split together have about so many bytes: a task's arrays take some twenty times that.
BYTES_AT_ONCE = 1 << 23
#: Rows of words that a task holds before it sums them up.
MOST_HELD = 1 << 20
#: What a cell has moved travels in so many parts.
PARTS = 16
COUNTS = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("t", pa.int64())])
ROWS = pa.schema([("part", pa.string()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("ids", pa.binary()), ("h", pa.int64()), ("word", pa.binary())])


def fresh_memory() -> None:
    """Give back what earlier tasks of this worker left free, and have the C library keep this task's small arrays: they come and go in every step, and fresh pages cost more than the sums in them."""
    pa.default_memory_pool().release_unused()
    try:
        c = ctypes.CDLL(None)
        c.malloc_trim(0)
        c.mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD
        c.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _word_batches(batches):
    """(word, how often in training documents, how often in all)."""
    held, rows = [], 0

    def summed():
        t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum"), ("t", "sum")])
        return pa.Table.from_arrays([t["word"], t["c_sum"], t["t_sum"]], schema=COUNTS)

    fresh_memory()
    for b in evenly(batches, 1, BYTES_AT_ONCE):
        words, n = split_words(b.column(1), lower=True)
        at, k = words.indices.to_numpy(), len(words.dictionary)
        train = np.repeat(~b.column(0).to_numpy(zero_copy_only=False), n)
        held.append(pa.Table.from_arrays([words.dictionary.cast(pa.binary()), pa.array(np.bincount(at[train], minlength=k)), pa.array(np.bincount(at, minlength=k))], schema=COUNTS))
        rows += k
        if rows > MOST_HELD:
            held = [summed()]
            if (rows := held[0].num_rows) > MOST_HELD // 2:
                yield from held[0].to_batches(1 << 16)
                held, rows = [], 0
    if held:
        yield from summed().to_batches(1 << 16)


def _count_batches(path: str):
    """How often each subword id occurs in words that occur c times."""

    def run(batches):
        fresh_memory()
        encoder, total = word_ids(path), None
        for b in evenly(batches, 0):
            ids, n = encoder.distinct(b.column(0).cast(pa.large_binary()))
            total = np.zeros(encoder.size) if total is None else total
            total += np.bincount(ids, np.repeat(b.column(1).to_numpy(), n), encoder.size)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "n"])

    return run


def with_units(encoder, words: pa.DictionaryArray, n: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each has): a word whose unit (one for each of the dictionary) isn't negative is that one id, behind the subwords'; the others are spelled."""
    spelled = unit < 0
    flat, some = encoder.distinct(words.dictionary.filter(pa.array(spelled)))
    many = np.ones(len(unit), np.int64)
    many[spelled] = some
    theirs = np.repeat(spelled, many)
    ids = np.empty(len(theirs), np.uint32)
    ids[theirs], ids[~theirs] = flat, encoder.size + unit[~spelled]
    return spread(ids, many, words.indices.to_numpy(), n)


def places(words: pa.Array, names: pa.Array) -> np.ndarray:
    """Where each of distinct words stands among distinct names, or -1. Arrow makes its table of the words, a batch's, which are fewer than the names."""
    word = pc.fill_null(pc.index_in(names, words), -1).to_numpy()
    there = np.flatnonzero(word >= 0)
    out = np.full(len(words), -1)
    out[word[there]] = there
    return out


def _row_batches(path: str, frequent, units: int, total: float, rounds: int):
    """Of each document a row with its ids, and what frequent words make of its baseline; of each other word it has a row with how often."""

    def run(batches):
        fresh_memory()
        encoder = word_ids(path)
        kind = _kind(encoder.size + units)
        with pa.ipc.open_stream(frequent.value) as stream:
            known = stream.read_all().combine_chunks()
        names, c = known["word"].combine_chunks() if known.num_rows else pa.array([], pa.binary()), np.append(known["c"].to_numpy(), 0)
        logs = np.log10((c + 1) / total)
        for b in evenly(batches, 2, BYTES_AT_ONCE):
            words, n = split_words(b.column(2), lower=True)
            place = places(words.dictionary.cast(pa.binary()), names)
            ids, size = with_units(encoder, words, n, np.where(place < units, place, -1))
            data, ends = memoryview(ids.astype(kind)).cast("B"), np.cumsum(size) * np.dtype(kind).itemsize
            parts = [bytes(data[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            docs = b.column(1).to_pylist()
            h = [zlib.crc32(p, zlib.crc32(str(d).encode())) for d, p in zip(docs, parts, strict=True)]
            part = ["held" if is_held_out(d) else f"r{x % rounds}" for d, x in zip(docs, h, strict=True)]
            which, owner = words.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
            there = place[which]
            found = there >= 0
            of_doc = lambda x: np.bincount(owner[found], x, len(n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                pa.array(part), b.column(0), b.column(1), pa.array(n), pa.array(of_doc(c[there[found]] > 0).astype(np.int64)), pa.array(of_doc(logs[there[found]])),
                pa.array(parts, pa.binary()), pa.array(h, pa.int64()), pa.nulls(len(n), pa.binary())], schema=ROWS)
            pair, many = np.unique(owner[~found] * len(words.dictionary) + which[~found], return_counts=True)
            k = len(pair)
            if k:
                row, word = np.divmod(pair, len(words.dictionary))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, "rare")), b.column(0).take(pa.array(row)), pa.nulls(k, pa.int64()), pa.array(many), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                    pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), words.dictionary.take(pa.array(word)).cast(pa.binary())], schema=ROWS)

    return run


def _kind(end: int):
    return np.uint16 if end < 1 << 16 else np.uint32


def blocks_of(texts: pa.Array, vocabulary: Vocabulary) -> Blocks:
    """The blocks of texts given as their ids' bytes; inputs are rows of vectors."""
    kind = _kind(vocabulary.end)
    size = pc.binary_length(texts).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    blocks = Blocks(np.frombuffer(b"".join(texts.to_pylist()), kind).astype(np.int32), size, vocabulary.end)
    blocks.x = vocabulary.inputs[blocks.x]
    return blocks


def _learn_batches(vocabulary, weights, rate: float):
    """How far steps on every window of a cell's documents move the weights, in PARTS parts, and how many targets they have."""

    def run(batches):
        fresh_memory()
        before, n = np.frombuffer(weights.value, np.float32), 0
        model = Model(vocabulary.value, before)
        for b in evenly(batches, 0, LEARNT_AT_ONCE):
            n += model.learn(blocks_of(b.column(0), vocabulary.value), rate)
        if n:
            parts, cell = np.array_split(model.flat - before, PARTS), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([cell] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * PARTS, pa.int64())], ["k", "cell", "moved", "n"])

    return run


def _mean_batches(batches):
    """The mean of what cells have moved, weighed by their targets; a part's rows come in the order of cells, so its sum is always the same."""
    sums: dict[int, list] = {}
    for b in batches:
        for k, moved, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            mine = sums.setdefault(k, [0.0, 0])
            mine[0], mine[1] = mine[0] + np.frombuffer(moved, np.float32).astype(np.float64) * n, mine[1] + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(m / n).astype(np.float32).tobytes() for m, n in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["k", "moved", "n"])


def _score_batches(vocabulary, weights):
    def run(batches):
        fresh_memory()
        model = Model(vocabulary.value, np.frombuffer(weights.value, np.float32))
        tables = model.tables(model.e)
        for b in evenly(batches, 5, IDS_AT_ONCE):
            scores = model.scores(blocks_of(b.column(5), vocabulary.value), tables, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(scores)], [*b.schema.names[:5], "score"])

    return run


def frequent_words(words: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, Column]:
    """At most ``most`` (word, c) of at most LONGEST bytes, the commonest of all documents, by falling c; and which rows of ``words`` they are."""
    short = F.octet_length("word") <= LONGEST
    rank = F.floor(F.log2(F.col("t").cast("double")) * 16).cast("int")
    left, least = most, None
    for r in sorted(words.filter(short).groupBy(rank.alias("rank")).count().collect(), key=lambda r: -r["rank"]):  # under 1024 rows
        if r["count"] > left:
            break
        left, least = left - r["count"], r["rank"]
    there = short & (rank >= least) if least is not None else F.lit(False)
    got = words.filter(there).select("word", "c").toArrow()
    return got.sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks(), there


def as_stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def input_rows(encoder, units: pa.Array) -> np.ndarray:
    """The row of the input vector of each subword and unit: the commonest units have one of their own, behind the subwords'."""
    own, last = min(len(units), OWN_INPUTS), []
    for i in range(own, len(units), 1 << 16):
        flat, n = encoder.distinct(units.slice(i, 1 << 16).cast(pa.large_binary()))
        last.append(np.append(flat, 0)[np.maximum(np.cumsum(n) - 1, 0)].astype(np.int64))
    return np.concatenate((np.arange(encoder.size + own), *last))


def train(parts: list[DataFrame], model: Model, vocabulary, cells: int) -> int:
    """A round for each part, in so many cells; gives how many targets all rounds had. ``vocabulary`` is the model's, broadcast."""
    model.plain, targets = True, 0
    for k, part in enumerate(parts):
        later = k - (len(parts) - ROUNDS)
        rate = START_RATE if later < 0 else ROUND_RATE * (1 - 0.9 * later / ROUNDS)
        weights = part.sparkSession.sparkContext.broadcast(model.flat.tobytes())
        cell = F.pmod(F.floor(F.col("h") / len(parts)), F.lit(cells)).cast("int")
        rows = part.select(cell.alias("cell"), "h", "doc_id", "ids").repartitionById(cells, "cell").sortWithinPartitions("h", "doc_id", "ids")
        moved = rows.select("ids").mapInArrow(_learn_batches(vocabulary, weights, rate), "k int, cell long, moved binary, n long")
        means = moved.repartition(PARTS, "k").sortWithinPartitions("k", "cell").mapInArrow(_mean_batches, "k int, moved binary, n long").collect()  # the weights, once
        weights.unpersist()
        if means:
            means.sort(key=lambda r: r["k"])
            model.step(-np.concatenate([np.frombuffer(r["moved"], np.float32) for r in means]), 1.0)
            targets += means[0]["n"]
    return targets


def score_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    A document is held out if crc32(doc_id) mod 7 is 2; a null id is not. Null
    and empty texts are their end token alone. Without training documents N and V
    are 0, no word is known and the model's counts are uniform. Rows repeat as in
    docs; each counts. Texts of any length are trained on and scored whole, as many
    windows as they have; a word of any length is one word.
    """
    path, spark = tokenizer or tokenizer_path(), docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    words = cut(rows.select(held.alias("held"), "text").mapInArrow(_word_batches, "word binary, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    sums = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = rows.filter(~held).count()
    n, v = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    total = float(n + v + 1)

    encoder, (common, among) = word_ids(path), frequent_words(words)
    units = common.filter(pc.greater_equal(common["c"], UNIT_LEAST)).combine_chunks()  # the first of the common words
    counts = np.zeros(encoder.size)
    spelled = words.filter((F.col("c") > 0) & ~(among & (F.col("c") >= UNIT_LEAST)))
    for r in spelled.select("word", "c").mapInArrow(_count_batches(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each subword
        counts[r["id"]] = r["n"]
    of_units = units["word"].combine_chunks() if units.num_rows else pa.array([], pa.binary())
    model = Model(Vocabulary(np.concatenate((counts, units["c"].to_numpy())), input_rows(encoder, of_units)))
    vocabulary = spark.sparkContext.broadcast(model.vocabulary)

    rounds, frequent = START_STEPS + ROUNDS, spark.sparkContext.broadcast(as_stream(common))
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = "part string, rid long, doc_id long, n_tokens long, n_known long, base double, ids binary, h long, word binary"
    where = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    numbered.mapInArrow(_row_batches(path, frequent, units.num_rows, total, rounds), schema).write.partitionBy("part").parquet(where)
    delete_at_exit(spark, where)
    frequent.unpersist()
    found = spark.read.schema(schema).parquet(where)

    if ends:
        train([found.filter(F.col("part") == f"r{k}") for k in range(rounds)], model, vocabulary, max(1, math.ceil(n / rounds / WORDS_A_CELL)))
    weights = spark.sparkContext.broadcast(model.flat.tobytes())
    scored = found.filter("part <> 'rare'").select("rid", "doc_id", "n_tokens", "n_known", "base", "ids").mapInArrow(_score_batches(vocabulary, weights), "rid long, doc_id long, n_tokens long, n_known long, base double, score double")
    rare = found.filter("part = 'rare'").select("rid", "word", "n_tokens").join(words.select("word", "c"), "word", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n_tokens")).otherwise(0)).alias("more"), F.sum(F.col("n_tokens") * F.log10((F.coalesce("c", F.lit(0)) + 1) / total)).alias("rest"))
    end = math.log10((ends + 1) / total)
    return scored.join(rare, "rid", "left").select(
        "doc_id", held.alias("held_out"), (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), "score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
