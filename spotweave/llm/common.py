"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: texts may be long, workers small.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
#: Bytes of a Parquet row group, which a writing task holds in memory.
ROW_GROUP = 16 << 20
#: Bytes of a written table for which one task is enough.
TASK_BYTES = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def frugal(run):
    """run, a function over a task's Arrow batches, so that the worker gives its memory back: workers
    are used again, and those that wait would hold on to what their last task needed."""

    def of(*batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: large blocks go back when they are freed
            pa.set_memory_pool(pa.system_memory_pool())
        yield from run(*batches)
        gc.collect()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return of


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode (tests) is one set here if there is none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"spotweave-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())



def materialize(df: DataFrame, what: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and no
    executor's loss makes what stands before it run again.  Its shuffles' files are deleted.  options: the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # row groups and pages are looked at from the first row on: a hundred long rows would be too many
        small = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
        df.write.options(**{k: str(v) for k, v in (small | options).items()}).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def size_of(*tables: DataFrame) -> int:
    """Bytes of materialized tables; of others what Spark's statistics give."""
    total = 0
    for t in tables:
        if getattr(t, "written_to", None):
            path, store = _path(t.sparkSession, t.written_to)
            total += store.getContentSummary(path).getLength()
        else:
            size = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            total += size if size < 1 << 55 else 0  # of what comes from no files Spark knows nothing
    return total


def drop(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "written_to", None):
            path, store = _path(t.sparkSession, t.written_to)
            store.delete(path, True)


def fitted(df: DataFrame, size: int) -> DataFrame:
    """df, made from so many bytes, in a task for each TASK_BYTES where that is less than a shuffle's number of tasks:
    small tables become few files, and the number of tasks grows with the data."""
    n = 1 + size // TASK_BYTES
    return df.coalesce(n) if n < partitions(df.sparkSession) else df


def local_path(uri: str) -> str | None:
    """The path of a shared folder that is mounted as files, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, each: int = 64 << 20) -> int:
    """Ranges into which df is dealt: those of a shuffle, and more where its estimated size asks for them."""
    return max(partitions(df.sparkSession), min(size_of(df) // each, 100_000))


def row_tag(text: Column) -> tuple[Column, Column]:
    """128 bits (two longs) that tell rows that share a doc_id apart by their texts."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)
