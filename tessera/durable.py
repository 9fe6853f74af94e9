"""Intermediate tables that outlive executors, and numbering without hot groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only if its files, written and measured, are smaller.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only where that is unset and Spark
    runs in one process, as in tests, one of our own is made; on a cluster other
    machines couldn't read it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.parquet(path, compression="zstd")
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def clear() -> None:
    """Remove what this process has materialised, once no frame made from it is
    read any more."""
    while _written:
        spark, path = _written.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def size_of(df: DataFrame) -> int:
    """Catalyst's size of a plan: file sizes for a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df


def number_within(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """``df`` plus ``out``, the place (from 1) of each row among those of its
    ``by`` in the given order.  Rows are dealt out by range, so a group that holds
    a third of all rows lies in many tasks; only the groups' counts in each range
    are added up by group."""
    ranged = df.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")  # written: a range, once drawn, stays
    counts = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("_by"), "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    both = ranged.withColumn("_inner", inner).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (ranged["_range"] == counts["_range"]))
    return both.select(*df.columns, (F.col("_before") + F.col("_inner")).cast("int").alias(out))
