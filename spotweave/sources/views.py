"""Molecules, vectors and counts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as molecules: molecule_id, x, y, z, gene_name, prior_segmentation, cell, confidence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6
    m = e.select(
        (F.col("event_id") + 1).alias("molecule_id"),
        F.col("value").cast("double").alias("x"),
        (seconds / 5184).alias("y"),
        (F.col("event_id") % 3).cast("int").alias("z"),
        F.concat(F.lit("g"), F.get_json_object("props", "$.k")).alias("gene_name"),
        F.col("user_id").cast("long").alias("prior_segmentation"),
        ((F.col("event_id") % 101) / 100.0).alias("confidence"),
    )
    tile = 1 + F.floor(F.col("y") / 50) * 10 + F.least(F.floor(F.col("x") / 50), F.lit(9))
    return m.withColumn("cell", tile.cast("int"))


#: The same view in DuckDB.
M_SQL = """M AS (SELECT event_id + 1 AS molecule_id, value::DOUBLE AS x, (epoch_us(ts) - 1704067200000000) / 1e6 / 5184 AS y, (event_id % 3)::INTEGER AS z,
  'g' || json_extract_string(props, '$.k') AS gene_name, user_id::BIGINT AS prior_segmentation, (event_id % 101) / 100.0::DOUBLE AS confidence,
  (1 + floor((epoch_us(ts) - 1704067200000000) / 1e6 / 5184 / 50) * 10 + least(floor(value / 50), 9))::INTEGER AS cell FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and part as weighted molecules: gene, cell, w."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), (F.col("l_suppkey") + 1).cast("long").alias("cell"), F.col("l_quantity").cast("double").alias("w"))


L_SQL = "L AS (SELECT p_brand AS gene, (l_suppkey + 1)::BIGINT AS cell, l_quantity::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey)"
