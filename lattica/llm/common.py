"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold at least this share of all rows count as hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where that is unset and Spark runs in this very process (tests), a
    temporary folder takes its place until the interpreter ends.
    """
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM remove a written table when it ends; results are read from it until then."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows: fewer than 1 / share rows, whatever the data."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg((F.count(F.lit(1)) * F.lit(share)).alias("__t")).first()["__t"]
    return counts.filter(F.col("__n") > F.lit(float(total))).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """left join right, where right has each key once and a key may hold any share of left's rows.

    Rows of hot keys meet their few right rows by broadcast (under 1 / HOT_SHARE
    rows, by the definition of hot), so none of those keys is gathered in one
    task; all others are joined by shuffle. Null keys find nothing. ``left`` is
    read more than once: hand in a scan or a cut table.
    """
    hot = hot_keys(left.filter(F.col(key).isNotNull()), key) if hot is None else hot
    keys = [r[0] for r in hot.collect()]  # under 1 / HOT_SHARE keys
    if not keys:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    few = F.broadcast(right.filter(is_hot))
    return left.filter(is_hot).join(few, key, "left").unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null where the column is."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")
