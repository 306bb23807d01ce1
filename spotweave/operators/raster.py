"""Raster masks as tables of (row, col, label)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from .filters import MAD, dense_numbers


def lookup(molecules: DataFrame, mask: DataFrame, name: str = "prior_segmentation") -> DataFrame:
    """The label of the pixel on which each molecule lies (coordinates rounded half to even), else 0."""
    m = mask.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), F.col("label").alias("_label"))
    at = (F.bround("y").cast("long") == F.col("_row")) & (F.bround("x").cast("long") == F.col("_col"))
    out = molecules.join(m, at, "left").withColumn("_new", F.coalesce("_label", F.lit(0)).cast("long")).drop("_row", "_col", "_label")
    return out.drop(name).withColumnRenamed("_new", name)


def mask_scale(mask: DataFrame) -> DataFrame:
    """scale (median radius of the labels, as of discs of their areas) and its normalised MAD."""
    radius = mask.where("label > 0").groupBy("label").agg(F.sqrt(F.count("*") / math.pi).alias("r"))
    return median_mad(radius, "r")


def median_mad(df: DataFrame, value: str) -> DataFrame:
    """scale and scale_std: median and normalised MAD of a column."""
    middle = quantiles(df, value, [0.5])[0]
    spread = None if middle is None else MAD * quantiles(df, F.abs(F.col(value) - middle), [0.5])[0]
    return df.sparkSession.createDataFrame([(middle, spread)], "scale double, scale_std double")


def label_parts(mask: DataFrame) -> DataFrame:
    """Connected parts (four neighbours) of the non-zero pixels, numbered in the order of their first pixel."""
    from .graph import connected

    pixels = mask.where("label != 0").select("row", "col").distinct().withColumn("id", F.col("row") * (1 << 31) + F.col("col"))
    right = pixels.select(F.col("id").alias("a"), (F.col("row") * (1 << 31) + F.col("col") + 1).alias("b"))
    below = pixels.select(F.col("id").alias("a"), ((F.col("row") + 1) * (1 << 31) + F.col("col")).alias("b"))
    edges = right.union(below).join(pixels.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    found = connected(pixels.select("id"), edges)
    numbers = dense_numbers(found, ["label"], "new")
    return pixels.join(found.join(numbers, "label").select("id", "new"), "id").select("row", "col", F.col("new").cast("long").alias("label"))
