"""Reports: aggregates made in Spark, small enough to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.vega import chart, page
from .aggregates import histogram


def noise_summary(molecules: DataFrame) -> DataFrame:
    """min_noise_frac: the share of molecules that are surely noise; expected_noise_frac: the mean of 1 - confidence."""
    return molecules.agg(F.avg(F.when(F.col("confidence") < 0.01, 1.0).otherwise(0.0)).alias("min_noise_frac"), F.avg(1 - F.col("confidence")).alias("expected_noise_frac"))


def real_and_noise(molecules: DataFrame, gene: str = "gene_name") -> DataFrame:
    """gene, n_real (confidence of 0.5 or more), n_noise."""
    real = F.col("confidence") >= 0.5
    return molecules.groupBy(F.col(gene).alias("gene")).agg(F.sum(F.when(real, 1).otherwise(0)).cast("long").alias("n_real"), F.sum(F.when(real, 0).otherwise(1)).cast("long").alias("n_noise"))


def panel_size(molecules: DataFrame, min_molecules_per_cell: int, min_pixels: int = 15, most: int = 3000) -> tuple[int, int]:
    """Width and height of a panel in which a cell has enough pixels."""
    n, dx, dy = molecules.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    side = min_pixels * (n / max(min_molecules_per_cell, 1)) ** 0.5
    ratio = (dy / dx if dx else 1.0) ** 0.5
    width, height = side * ratio**-0.5, side * ratio
    shrink = min(1.0, most / max(width, height, 1))
    return max(1, round(width * shrink)), max(1, round(height * shrink))


def confidence_bins(molecules: DataFrame) -> DataFrame:
    """Histogram of confidence in steps of 0.025, of assigned molecules and of noise."""
    kinds = [histogram(molecules.where(c), "confidence", 0.0, 0.025).withColumn("kind", F.lit(k)) for k, c in (("assigned", "cell > 0"), ("noise", "cell = 0"))]
    return kinds[0].union(kinds[1])


def cells_by_size(cells: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of molecules in a cell: more than one, and below q.99 / .99."""
    top = (quantiles(cells, "n_transcripts", [0.99])[0] or 1.0) / 0.99
    return histogram(cells.where((F.col("n_transcripts") > 1) & (F.col("n_transcripts") < top)), "n_transcripts", 0.0, max(top / bins, 1.0))


def diagnostics_page(molecules: DataFrame, cells: DataFrame, trace: DataFrame | None = None, changes: list[float] | None = None) -> str:
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  histograms of a few dozen bins
    charts = {"confidence": chart(rows(confidence_bins(molecules)), "bar", "Confidence", x="bin:Q", y="n:Q", color="kind:N"), "sizes": chart(rows(cells_by_size(cells)), "bar", "Molecules per cell", x="bin:Q", y="n:Q")}
    if "assignment_confidence" in molecules.columns:
        charts["assignment"] = chart(rows(histogram(molecules.where("cell > 0"), "assignment_confidence", 0.0, 1 / 30)), "bar", "Assignment confidence", x="bin:Q", y="n:Q")
    if trace is not None:
        charts["cells"] = chart(rows(trace), "line", "Cells by iteration", x="iteration:Q", y="n_cells:Q", color="threshold:N")
    if changes:
        charts["clusters"] = chart([{"iteration": i + 1, "change": c} for i, c in enumerate(changes)], "line", "Largest change of clusters", x="iteration:Q", y="change:Q")
    return page("Segmentation", charts)


def preview_page(molecules: DataFrame, distances: DataFrame, structure: DataFrame | None = None) -> str:
    """The page of a preview: noise, transcripts by gene, and how genes lie to one another."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    top = quantiles(distances, "d", [0.99])[0] or 1.0
    noise = noise_summary(molecules).first()
    charts = {"noise": chart(rows(histogram(distances.where(F.col("d") < top), "d", 0.0, top / 50)), "bar", "Distance to neighbours", x="bin:Q", y="n:Q"), "genes": chart(rows(real_and_noise(molecules).orderBy("gene")), "bar", "Transcripts", x="gene:N", y="n_real:Q")}
    if structure is not None:
        charts["structure"] = chart(rows(structure), "point", "Gene structure", x="x:Q", y="y:Q", size="size:Q", tooltip="gene:N")
    text = f"<p>Minimal noise level: {100 * (noise[0] or 0):.3f}%. Expected noise level: {100 * (noise[1] or 0):.3f}%.</p>"
    return page("Preview", charts, text)


def scatter_page(molecules: DataFrame, colour: str, most: int = 100_000) -> str:
    """A picture of the molecules in their colours: at most so many points, evenly by hash (a drawing's bound)."""
    n = molecules.count()
    some = molecules if n <= most else molecules.where(F.pmod(F.xxhash64("molecule_id"), F.lit(-(-n // most))) == 0)
    rows = [r.asDict() for r in some.select("x", "y", F.col(colour).alias("colour")).collect()]
    return page("Transcripts", {"scatter": chart(rows, "point", "Transcripts", x="x:Q", y="y:Q", color={"field": "colour", "type": "nominal", "scale": None})})
