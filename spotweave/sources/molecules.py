"""Molecule tables from files: binding of columns, normalisation, filters, numbering."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import encode_genes, exclude_genes, frequent_genes, number_rows
from ..options import DataOptions

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet file, by its extension in any case."""
    kind = re.sub(r"^.*\.", "", path.rstrip("/")).lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {kind}")


def bind_columns(df: DataFrame, options: DataOptions, only_bound: bool = False) -> DataFrame:
    """The configured columns as x, y, z, gene.  A column that already has such a name becomes
    <name>_reserved, replacing an older one.  A z of the default name may be absent."""
    bound = ["x", "y", "gene"]
    for name in ("x", "y", "z", "gene"):
        given = getattr(options, name)
        if given not in df.columns:
            if name == "z" and given == "z":
                continue
            raise ValueError(f"column {given} not found")
        if given != name:
            if name in df.columns:
                df = df.drop(f"{name}_reserved").withColumnRenamed(name, f"{name}_reserved")
            df = df.withColumnRenamed(given, name)
        if name == "z":
            bound.append("z")
    return df.select(*bound) if only_bound else df


def normalise(df: DataFrame, force_2d: bool = False) -> DataFrame:
    """Coordinates as doubles, genes as strings ("missing" for null), and no z that has fewer than two values."""
    df = df.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "z") if c in df.columns})
    df = df.withColumn("gene", F.coalesce(F.col("gene").cast("string"), F.lit("missing")))
    if "z" in df.columns and (force_2d or df.agg(F.min("z") == F.max("z")).first()[0] is not False):
        df = df.drop("z")
    return df


def load_molecules(spark: SparkSession, path: str, options: DataOptions) -> tuple[DataFrame, DataFrame]:
    """Molecules (molecule_id, x, y[, z], gene code, gene_name, all other columns) and the gene dictionary.

    Molecules are numbered in the order of their coordinates and genes, which, unlike that of the
    file, does not depend on how it is split."""
    df = normalise(bind_columns(read_table(spark, path), options), options.force_2d)
    df = df.withColumnRenamed("gene", "gene_name")
    df = frequent_genes(df, options.min_molecules_per_gene)
    if options.exclude_genes:
        df = exclude_genes(df, options.exclude_genes)
    df, genes = encode_genes(df)
    order = [c for c in ("x", "y", "z", "gene_name") if c in df.columns]
    return number_rows(df, order), genes


def repeated_rows(df: DataFrame) -> int:
    """How many rows repeat another one whole."""
    counts = df.groupBy(*df.columns).count().agg(F.sum("count") - F.count("*")).first()[0]
    if counts:
        log.warning("%d rows repeat others", counts)
    return int(counts or 0)


MASK = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("label", T.LongType())])


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """A raster mask as a table (row, col, label), 1-based, zeros left out.  Images need a decoder
    that is not at hand; a mask of one label has its connected parts labelled."""
    from ..operators.raster import label_parts

    df = read_table(spark, path).select(*(F.col(f.name).cast("long") for f in MASK)).where("label != 0")
    one = df.agg(F.min("label") == F.max("label")).first()[0]
    return label_parts(df) if one else df


def prior_from_column(df: DataFrame, column: str, unassigned: str = "0", min_molecules: int = 0) -> DataFrame:
    """prior_segmentation from a column of labels (":name" or "name")."""
    from ..operators.filters import parse_prior, small_segments

    column = column.removeprefix(":")
    if column not in df.columns:
        raise ValueError(f"column {column} not found")
    return small_segments(parse_prior(df, column, unassigned), min_molecules)
