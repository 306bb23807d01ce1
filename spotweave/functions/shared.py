"""Tables cut from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one is set only where a local session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"spotweave-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """df, written and read again: its plan ends here, and the loss of an executor cannot undo it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete cut tables that nothing reads any more: of a loop's states only the last is kept."""
    for t in tables:
        if getattr(t, "written_to", None):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def save_file(spark: SparkSession, path: str, parts) -> None:
    """Strings as one file at a path of any store that Spark reaches."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = store.create(to, True)
    try:
        for p in parts:
            out.write(bytearray(p.encode("utf-8")))
    finally:
        out.close()
