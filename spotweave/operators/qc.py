"""Tables about molecules and cells after segmentation, and hulls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import convex_hull, ring_area
from ..functions.scalar import cell_name, significant
from .aggregates import cluster_fraction


def hull_areas(df: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, area of the convex hull.  A hull of hulls is the hull: each cell is reduced to hulls of up to 10000 of its
    molecules first, so that no task holds a large cell whole."""
    own = df.where(F.col(cell) > 0).select(F.col(cell).alias("cell"), "x", "y")
    part = F.pmod(F.xxhash64("x", "y"), F.greatest(F.lit(1), F.ceil(F.col("_n") / 10_000)))
    sizes = own.groupBy("cell").agg(F.count("*").alias("_n"))
    dealt = own.join(sizes, "cell").select("cell", part.alias("part"), "x", "y")
    t = dict(own.dtypes)["cell"]

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "area": [ring_area(convex_hull(pdf[["x", "y"]].to_numpy()))]})

    hulls = dealt.groupBy("cell", "part").applyInPandas(reduced, f"cell {t}, x double, y double")
    return hulls.groupBy("cell").applyInPandas(area, f"cell {t}, area double")


def cell_table(df: DataFrame, hulls: bool = True, dims: tuple = ("x", "y"), lifespans: DataFrame | None = None) -> DataFrame:
    """One row for each cell with molecules: centre, n_transcripts, density, elongation, area, averages of
    confidences, and the share of the main cluster.  Cells of one or two molecules have no shape (NaN)."""
    own = df.where(F.col("cell") > 0)
    cols = set(df.columns)
    aggs = [F.avg(d).alias(d) for d in dims] + [F.count("*").alias("n_transcripts")]
    aggs += [F.var_pop("x").alias("_a"), F.var_pop("y").alias("_b"), F.covar_pop("x", "y").alias("_c")]
    for c in ("confidence", "assignment_confidence"):
        if c in cols:
            aggs.append(F.avg(c).alias(f"avg_{c}"))
    per = own.groupBy("cell").agg(*aggs)
    half, gap = (F.col("_a") + F.col("_b")) / 2, F.sqrt(F.pow((F.col("_a") - F.col("_b")) / 2, F.lit(2)) + F.col("_c") * F.col("_c"))
    nan, enough = F.lit(float("nan")), F.col("n_transcripts") > 2
    per = per.withColumn("elongation", F.when(enough, significant(F.coalesce(F.try_divide(half + gap, half - gap), nan))).otherwise(nan))
    if hulls:
        per = per.join(hull_areas(own), "cell", "left")
        area = significant(F.col("area"))
        per = per.withColumn("area", F.when(enough, area).otherwise(nan))
        per = per.withColumn("density", F.when(enough, significant(F.coalesce(F.try_divide(F.col("n_transcripts"), F.col("area")), nan))).otherwise(nan))
    for c in ("avg_confidence", "avg_assignment_confidence"):
        if c in per.columns:
            per = per.withColumn(c, significant(F.col(c)))
    if "cluster" in cols:
        per = per.join(cluster_fraction(own).withColumnRenamed("main_cluster", "cluster"), "cell", "left")
    if lifespans is not None:
        per = per.join(lifespans, "cell", "left").withColumn("lifespan", F.coalesce("lifespan", F.lit(-1)))
    return per.drop("_a", "_b", "_c")


def molecule_table(df: DataFrame, run_id: str, has_history: bool = True) -> DataFrame:
    """The segmentation table: named cells, rounded confidences, is_noise."""
    out = df.withColumn("is_noise", F.col("cell") == 0).withColumn("cell", cell_name(F.col("cell"), run_id))
    if "confidence" in df.columns:
        out = out.withColumn("confidence", F.bround("confidence", 5))
    if "assignment_confidence" in df.columns:
        out = out.withColumn("assignment_confidence", F.bround("assignment_confidence", 5)) if has_history else out.drop("assignment_confidence")
    return out

