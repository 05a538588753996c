"""Dense numbers for rows in an order, and lineage cut in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: its plan ends there.

    The folder is the one spark.checkpoint.dir names; a temporary one serves only
    where that is unset and Spark runs within this process.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="lattica-"))
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with dense numbers in the given order: a range sort, then offsets from counts of partitions."""
    at = f"__{name}_at"
    spread = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))
    got = spread.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    return got.withColumn(name, F.col("__before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("__part", "__before", at)
