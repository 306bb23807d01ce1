"""Aggregations over molecules, cells and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_array(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Molecules (or their weights) of each positive key."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(key) > 0).groupBy(key).agg(n.alias("n"))


def split_ids(df: DataFrame, key: str, member: str = "molecule_id", drop_zero: bool = True) -> DataFrame:
    """The sorted members of each group, for groups known to be small; larger ones stay long."""
    some = df.where(F.col(key) > 0) if drop_zero else df
    return some.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("ids"))


def sparse_counts(df: DataFrame, key: str, item: str, weight: Column | None = None, normalise: bool = False, least: float = 1e-5) -> DataFrame:
    """key, item, v: summed weights above a floor; normalised, they add up to 1 in each key."""
    w = F.lit(1.0) if weight is None else weight
    out = df.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.sum(w).alias("v")).where(F.col("v") > least)
    if normalise:
        out = out.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy(key)))
    return out


def count_matrix(df: DataFrame, gene: str = "gene_name", cell: str = "cell", weight: str | None = None) -> DataFrame:
    """Long count matrix: gene, cell, n."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(cell) > 0).groupBy(F.col(gene).alias("gene"), F.col(cell).alias("cell")).agg(n.alias("n"))


def smoothed_frequency(df: DataFrame, key: str, smooth: float = 0.0) -> DataFrame:
    """Frequencies with additive smoothing: (n + s) / (total + s * largest key)."""
    per = df.where(F.col(key) > 0).groupBy(key).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("_total"), F.max(key).alias("_most"))
    return per.join(F.broadcast(total), F.lit(True)).select(key, ((F.col("n") + smooth) / (F.col("_total") + smooth * F.col("_most"))).alias("p"))  # total: one row


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def weighted_sd(value: Column, weight: Column) -> Column:
    """Population standard deviation, from sums of w, wx, wx2 in one pass."""
    mean = weighted_mean(value, weight)
    return F.sqrt(F.greatest(F.try_divide(F.sum(weight * value * value), F.sum(weight)) - mean * mean, F.lit(0.0)))


def floored_mean(value: Column, weight: Column, floor: float = 0.01) -> Column:
    w = F.greatest(weight, F.lit(floor))
    return F.sum(w * value) / F.sum(w)


def mode(df: DataFrame, key: str, value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each key; the least one wins ties."""
    per = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    return per.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value))).alias(name), F.max("_n").alias("n_mode"), F.sum("_n").alias("n_all"))


def expressed_genes(df: DataFrame, cell: str = "cell", gene: str = "gene_name") -> DataFrame:
    return df.where(F.col(cell) > 0).groupBy(cell).agg(F.countDistinct(gene).alias("n_genes"), F.count(gene).cast("double").alias("sum_counts"))


def noise_composition_density(per_cell: DataFrame) -> DataFrame:
    """Mean over cells with counts of 1 / expressed genes."""
    return per_cell.where(F.col("sum_counts") > 1e-3).agg(F.avg(F.try_divide(F.lit(1.0), F.col("n_genes"))).alias("density"))


def largest_change(before: DataFrame, after: DataFrame, keys: list[str], value: str, confidence: DataFrame, molecule: str) -> DataFrame:
    """Largest change of a value times the molecule's confidence, and the share of molecules that changed."""
    both = before.select(*keys, F.col(value).alias("_a")).join(after.select(*keys, F.col(value).alias("_b")), keys)
    per = both.groupBy(molecule).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("d")).join(confidence.select(molecule, "confidence"), molecule)
    change = F.col("d") * F.col("confidence")
    return per.agg(F.max(change).alias("max_change"), F.avg(F.when(change > 1e-7, 1.0).otherwise(0.0)).alias("share_changed"))


def size_trace(per_cell: DataFrame, least: int, n: str = "n") -> DataFrame:
    """How many cells have at least max(round(f * least), 1) molecules, for f of 0, 1/2, 1, 2 and 5."""
    limits = sorted({max(round(f * least), 1) for f in (0, 0.5, 1, 2, 5)})
    sums = per_cell.agg(*(F.coalesce(F.sum(F.when(F.col(n) >= t, 1).otherwise(0)), F.lit(0)).alias(str(t)) for t in limits))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(str(t)).cast("long").alias("n_cells")) for t in limits))).alias("s")).select("s.*")


def cluster_fraction(df: DataFrame, cell: str = "cell", cluster: str = "cluster") -> DataFrame:
    """Share of each cell's molecules that the most frequent cluster has."""
    m = mode(df.where(F.col(cell) > 0), cell, cluster, "main_cluster")
    return m.select(cell, "main_cluster", (F.col("n_mode") / F.col("n_all")).alias("max_cluster_frac"))


def lifespan(history: DataFrame, last: int) -> DataFrame:
    """Iterations for which each component has lived: the last one less the first in which it was seen, plus 1."""
    return history.groupBy("guid").agg((F.lit(last) - F.min("iter") + 1).cast("long").alias("lifespan"))


def histogram(df: DataFrame, value: str, low: float, step: float, name: str = "bin") -> DataFrame:
    """Counts and shares of the bins [low + i * step, low + (i + 1) * step)."""
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - low) / step).cast("long").alias(name)).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n").alias("_t"))
    return bins.join(F.broadcast(total), F.lit(True)).select(name, "n", (F.col("n") / F.col("_t")).alias("fraction"))  # total: one row


def value_range(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def cooccurrence(edges: DataFrame, molecules: DataFrame, least_confidence: float = 0.95, gene: str = "gene_name") -> DataFrame:
    """Weighted gene pairs over symmetric edges between molecules of enough confidence, over the root of
    the product of the genes' own weights (0.1 at least)."""
    sure = molecules.where(F.col("confidence") >= least_confidence)
    a = sure.select(F.col("molecule_id").alias("src"), F.col(gene).alias("g1"))
    b = sure.select(F.col("molecule_id").alias("dst"), F.col(gene).alias("g2"))
    pairs = edges.join(a, "src").join(b, "dst").groupBy("g1", "g2").agg(F.sum("weight").alias("w"))
    own = pairs.groupBy("g1").agg(F.sum("w").alias("w1"))
    other = own.select(F.col("g1").alias("g2"), F.col("w1").alias("w2"))
    return pairs.join(own, "g1").join(other, "g2").select("g1", "g2", (F.col("w") / F.greatest(F.sqrt(F.col("w1") * F.col("w2")), F.lit(0.1))).alias("v"))


def segments_of_cells(df: DataFrame, cell: str = "cell", segment: str = "prior_segmentation") -> tuple[DataFrame, DataFrame]:
    """Molecules of each (cell, segment), and each cell's main segment: by the share of the cell, then by
    the size of the segment, then by the lesser id; 0 if most molecules have none."""
    per = df.where(F.col(cell) > 0).groupBy(cell, segment).agg(F.count("*").alias("n"))
    sizes = df.groupBy(segment).agg(F.count("*").alias("segment_size"))
    ranked = per.join(sizes, segment).groupBy(cell).agg(F.min_by(F.struct(segment, "n"), F.struct((-F.col("n")).alias("a"), (-F.col("segment_size")).alias("b"), F.col(segment))).alias("m"))
    return per.where(F.col(segment) > 0), ranked.select(cell, F.col(f"m.{segment}").alias("main_segment"), F.col("m.n").alias("n_main"))
