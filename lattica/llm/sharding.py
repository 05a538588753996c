"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered from 0 in the order of (doc_id, text crc, size), whatever the
files and partitions; a keyed Feistel network over the least power of two that
holds N, walked until it falls below N, permutes the numbers; position p goes
to shard p mod S, slot p div S. Anyone who knows N, S and the seed can compute
where a row lies. Counts of shards differ by one at most (law "rows").
DataFrame functions only; one range shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

ROUNDS = 6
#: The domain is under 2 N, so each step of a walk ends it with a chance over a half.
MOST_STEPS = 96


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The place of x (0 <= x < n) under the permutation of 0..n-1; n is known on the driver."""
    bits = max(2, (n - 1).bit_length())
    left, right = bits // 2, bits - bits // 2
    # The halves change places each round, so the one that is changed has `left` bits in even rounds.
    mask = lambda i: F.when(i % 2 == 0, F.lit((1 << left) - 1)).otherwise(F.lit((1 << right) - 1))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(v: Column) -> Column:
        start = F.struct(F.shiftright(v, right).alias("l"), v.bitwiseAND(F.lit((1 << right) - 1)).alias("r"))
        return F.aggregate(
            rounds,
            start,
            lambda s, i: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(s["r"], i, F.lit(seed)).bitwiseAND(mask(i).cast("long"))).alias("r")),
            lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), step(x), lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def row_numbers(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """rows with their place (from 0) in the given order, and how many there are.

    Ties are split between range partitions by a last key, so equal rows, however
    many, burden no single task; the rows that share a place in the order must be
    alike in every column, so it doesn't matter which gets which number. Only
    counts by partition are summed in one task.
    """
    tie, at = f"__{name}_tie", f"__{name}_at"
    keyed = rows.withColumn(tie, F.monotonically_increasing_id())
    spread = keyed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    spread = cut(spread.withColumn(at, F.monotonically_increasing_id()))
    part, index = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    numbered = spread.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    return numbered.withColumn(name, F.col("__before") + index).drop("__part", "__before", at), spread.count()


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size: UTF-8 bytes plus 16; a null text counts as empty (size 16, crc 0). Null
    ids come first in the order; repeated rows each have a slot of their own. An
    empty table gives an empty result. grown_shard is null: the law is "rows".
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("p", permute(F.col("row_number"), max(n, 1), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
