"""Filters and encoders of molecules."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.shared import cut

log = logging.getLogger(__name__)

#: Fixed value: a normal distribution's standard deviation over its median absolute deviation.
MAD = 1.4826022185056018


def frequent_genes(df: DataFrame, least: int, gene: str = "gene_name") -> DataFrame:
    """Molecules of genes with at least so many molecules."""
    if least <= 1:
        return df
    frequent = df.groupBy(gene).count().where(F.col("count") >= least).select(gene)
    return df.join(frequent, gene, "left_semi")


def exclude_genes(df: DataFrame, masks: str, gene: str = "gene_name") -> DataFrame:
    """Without genes in which one of the comma-listed regular expressions matches anywhere."""
    patterns = [p.strip() for p in masks.split(",") if p.strip()]
    if not patterns:
        return df
    met = df.agg(*(F.max(F.coalesce(F.col(gene).rlike(p), F.lit(False))) for p in patterns)).first()
    for p, some in zip(patterns, met):
        if not some:
            log.warning("no gene matches %s", p)
    return df.where(~F.coalesce(F.col(gene).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def dense_numbers(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct values of columns with their rank from 1."""
    return number_rows(df.select(*columns).distinct(), columns, name)


def encode_genes(df: DataFrame, gene: str = "gene_name") -> tuple[DataFrame, DataFrame]:
    """df with the code of its gene (1-based, in sorted order; null stays null), and the dictionary."""
    genes = dense_numbers(df.where(F.col(gene).isNotNull()), [gene], "gene").withColumn("gene", F.col("gene").cast("int"))
    return df.join(genes, gene, "left"), genes


def number_rows(df: DataFrame, order: list[str], name: str = "molecule_id") -> DataFrame:
    """Rows numbered from 1 in an explicit order: ranges, written once, and the prefix sums of their
    sizes.  No task sees more than its range."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    bases, total = [], 0
    for part, k in sorted((r[0], r[1]) for r in parts.groupBy("_part").count().collect()):  # one row for each range
        bases.append((part, total))
        total += k
    base = spark.createDataFrame(bases, "_part int, _base long")
    return inner.join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")


def parse_prior(df: DataFrame, label: str, unassigned: str = "0", name: str = "prior_segmentation") -> DataFrame:
    """Labels as dense numbers in sorted order; the unassigned label and null are 0."""
    known = df.where(F.col(label).isNotNull() & (F.col(label).cast("string") != unassigned))
    codes = dense_numbers(known, [label], "_code").withColumnRenamed(label, "_label")
    out = df.join(codes, F.col(label) == F.col("_label"), "left").withColumn("_new", F.coalesce("_code", F.lit(0)).cast("long")).drop("_code", "_label")
    return out.drop(*([name] if name in df.columns else [])).withColumnRenamed("_new", name)


def small_segments(df: DataFrame, least: int, label: str = "prior_segmentation") -> DataFrame:
    """Labels with fewer than so many molecules become 0."""
    sizes = df.where(F.col(label) > 0).groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label, F.lit(True).alias("_keep"))
    return df.join(sizes, label, "left").withColumn(label, F.when(F.col("_keep"), F.col(label)).otherwise(F.lit(0)).cast("long")).drop("_keep")


def long_edges(edges: DataFrame, n_mads: float = 2.0, length: str = "length") -> DataFrame:
    """Edges whose log10 length is below median + n_mads normalised MADs; length 0 stays."""
    logs = edges.withColumn("_l", F.when(F.col(length) > 0, F.log10(length)))
    median = quantiles(logs, "_l", [0.5])[0]
    if median is None:
        return edges
    mad = MAD * quantiles(logs, F.abs(F.col("_l") - median), [0.5])[0]
    return logs.where(F.coalesce(F.col("_l") < median + n_mads * mad, F.lit(True))).drop("_l")


def select_uniformly(df: DataFrame, n: int, threshold: float = 0.25, dims: tuple = ("x", "y"), key: str = "molecule_id") -> DataFrame:
    """About n rows, evenly by rank of the sum of coordinates among those of enough confidence."""
    if n <= 1:
        raise ValueError("at least two rows must be selected")
    some = df.where(F.col("confidence") >= threshold).withColumn("_s", sum((F.col(c) for c in dims), F.lit(0.0)))
    high = some.count()
    if high <= n:
        return df.join(some.select(key), key, "left_semi") if high else df
    ranked = number_rows(some, ["_s", key], "_rank").drop("_s")
    # rank r is taken if some i of 0..n-1 rounds to it: only the two nearest i can
    step = (high - 1) / (n - 1)
    near = F.floor((F.col("_rank") - 1) / step)
    hits = [F.bround(1 + (near + d) * step) == F.col("_rank") for d in (0, 1)]
    return ranked.where(hits[0] | hits[1] & (near + 1 <= n - 1)).drop("_rank")


def drop_unused(assigned: DataFrame, least: int, cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Cells of fewer than so many molecules go (their molecules to 0), the others are numbered anew in
    their order.  Gives the assignment and the map (old, new)."""
    big = assigned.where(F.col(cell) > 0).groupBy(cell).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    renamed = dense_numbers(big, [cell], "new").select(F.col(cell).alias("old"), "new")
    out = assigned.join(renamed, F.col(cell) == F.col("old"), "left").withColumn(cell, F.coalesce("new", F.lit(0)).cast("int")).drop("old", "new")
    return out, renamed

