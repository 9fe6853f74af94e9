"""Helpers shared by the corpus operators: row identity, durable intermediate
tables, and bounded Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Text bytes that one numpy pass works on; bounds a worker's temporaries.
SLICE_BYTES = 4 << 20
#: Upper bound of one Arrow batch sent to a worker.
BATCH_BYTES = 16 << 20
#: A table is broadcast only if its files, written and measured, are smaller.
BROADCAST_BYTES = 2 << 20
LAST = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).  Only
    where it is unset and Spark runs in one process, as in tests, one of our own
    is made; on a cluster a machine's own folder would lose rows, so that is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    in storage that outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are no larger than
    ``BROADCAST_BYTES``; a larger one is joined by shuffle."""
    return F.broadcast(df) if input_bytes(df) <= BROADCAST_BYTES else df


def free_name(base: str, *tables: DataFrame) -> str:
    """A column name like ``base`` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: What operators keep in a worker between tasks, and how to drop it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _kept[owner] = drop


def release(owner: str) -> None:
    """Called by an operator's tasks: drop what other operators keep in this
    worker and give freed memory back.  Workers live on from job to job, and what
    one has left counts against the next."""
    for name in [x for x in _kept if x != owner]:
        _kept.pop(name)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it trims by itself or not at all
        return


def bounded_batches(spark: SparkSession) -> None:
    """Cap Arrow batches by bytes as well as rows, so that a run of very long
    texts can't outgrow a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None) or "")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def doc_order(doc_id: Column) -> Column:
    """An integer doc_id as a non-null sort key; a missing id sorts after all
    others."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def numbered(docs: DataFrame, key: str, out: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a long column ``out`` in the order of ``key``, nulls last;
    and, for keys that aren't integers, the table (key, out) of its numbers."""
    column = F.col(f"`{key}`")
    if isinstance(docs.schema[key].dataType, IntegralType):
        return docs.withColumn(out, doc_order(column)), None
    keys = docs.select(column.alias("_own")).where("_own IS NOT NULL").distinct().orderBy("_own")
    keys = materialise(keys.withColumn("_number", F.monotonically_increasing_id()), "key-numbers")
    own, number = free_name("_own", docs), free_name(f"{out}_key", docs)
    found = docs.join(keys.select(F.col("_own").alias(own), F.col("_number").alias(number)), column == F.col(own), "left")
    return found.withColumn(out, F.coalesce(F.col(number), F.lit(LAST))).drop(own, number), keys


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """Buckets so that each holds about ``per_bucket`` input bytes, and at
    least two for each shuffle partition."""
    size = input_bytes(df)
    size = 0 if size > 1 << 60 else size  # an unknown size reads as the maximum
    return max(2 * parallelism(df.sparkSession), -(-size // per_bucket))


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` dealt out by its bucket, about one to a task, but to no more than
    four times the session's partitions."""
    return df.repartition(min(buckets, 4 * parallelism(df.sparkSession)), "bucket")


def text_slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose byte lengths add up to about ``limit``."""
    if not len(lengths):
        return
    ends = np.cumsum(lengths)
    start, base = 0, 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        base, start = int(ends[stop - 1]), stop


def binary_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string or binary column (null: empty) and
    its n+1 offsets, without a copy for each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
