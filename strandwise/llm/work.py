"""Shared plumbing of the training-data operators: shipping code, written intermediates, gapless numbering."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from its install path (or from --py-files, where that path is absent)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        sc.setCheckpointDir(base)
    return base


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark's own writers would give it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(conf).makeQualified(found).toString()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandwise/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what operators wrote to the shared folder. Results that were not written out can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/strandwise")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has a row for each ``key`` and in ``count`` how many rows have it (dropped). Keys of over a ten-thousandth of the ``total`` rows, so at most 10,000 keys, are sent to the rows; the others, of which none is large, are joined by a shuffle."""
    common = F.col(count) > total / 10_000
    marked = rows.join(F.broadcast(table.filter(common).drop(count).withColumn("_hot", F.lit(True))), key, "left")
    rare = marked.filter("_hot is null").select(*rows.columns).join(table.filter(~common).drop(count), key)
    return marked.filter("_hot").drop("_hot").unionByName(rare)


def order_hash(*cols: Column) -> Column:
    """A fixed pseudo-random signed 64-bit order key."""
    return F.xxhash64(F.lit("order"), *cols)


def numbered(df: DataFrame, group: list[str], key: str, ties: list[str], weight: str | None = None, max_bucket: int | None = None, rows: int | None = None, key_bits: int = 64, bucket: Column | None = None) -> DataFrame:
    """Add ``slot`` (gapless from 0 in each group) and, given ``weight``, ``before`` (sum of the weights ahead of the row).

    ``key`` is a hash column of ``key_bits`` bits (of fewer than 64: not negative); a group is cut into buckets by its leading bits, so no task ever
    holds a whole group: bucket totals are pre-aggregated, summed up over buckets, and rows are numbered
    within their bucket alone. There are about as many buckets as the square root of the rows, so both steps
    see groups of that order (more buckets, where one must not exceed ``max_bucket`` rows). ``bucket`` gives the buckets of a key that is no hash, in its order. Group columns must not be null.
    """
    n = 1 if bucket is not None else df.count() if rows is None else rows
    bits = min(24, math.ceil(max(math.log2(max(1, n)) / 2, math.log2(max(1, n / (max_bucket or n or 1))))))
    if bucket is None:
        bucket = F.shiftright(F.col(key), key_bits - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_bucket", bucket)
    totals = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    up_to = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(*group, "_bucket").agg(*totals)
    heads = heads.select(*group, "_bucket", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_w").over(up_to), F.lit(0)).alias("_w0")] if weight else []))
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, *ties)
    out = df.withColumn("_rank", F.row_number().over(inside))
    if weight:
        out = out.withColumn("_sum", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(heads, [*group, "_bucket"])
    out = out.withColumn("slot", (F.col("_n0") + F.col("_rank") - 1).cast("long"))
    if weight:
        out = out.withColumn("before", (F.col("_w0") + F.col("_sum") - F.col(weight)).cast("long"))
    return out.drop("_bucket", "_rank", "_sum", "_n0", "_w0")
