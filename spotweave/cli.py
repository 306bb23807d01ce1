"""Commands: run (segmentation), preview, segfree."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import split_list
from .functions.shared import cut
from .operators import aggregates, clusters, graph, knn, ncv, noise, polygons, qc, raster, reports, segmentation
from .options import RunOptions, derive, dump_options, load_options, parse_scale_std, validate
from .sources import molecules as sources
from .sources import sinks


def _genes(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(split_list(F.lit(text))).first()[0] if text else []


def run(spark: SparkSession, coordinates: str, options: RunOptions, prior: str | None = None, output: str = "segmentation.csv", count_matrix: str = "tsv", polygon_format: str = "FeatureCollection", plot: bool = False, seed: int = 0) -> dict:
    """The whole segmentation of a file of molecules; writes all tables and gives them."""
    d, s = options.data, options.segmentation
    options = validate(options, prior is not None)
    s = options.segmentation
    paths, run_id = sinks.output_paths(output), f"R{uuid.uuid4().hex[:9]}"
    sinks.save_text(paths.params, dump_options(options))
    log = sinks.set_up_log(paths.log)
    mols, genes = sources.load_molecules(spark, coordinates, d)
    mols = cut(mols, "molecules")
    n, dims = mols.count(), tuple(c for c in ("x", "y", "z") if c in mols.columns)
    log.info("loaded %d molecules", n)
    more = derive(d.min_molecules_per_cell, genes.count(), n)
    scale, scale_std = s.scale, parse_scale_std(s.scale_std, s.scale)
    if prior:
        least = d.min_molecules_per_segment or more.min_molecules_per_segment
        if prior.startswith(":"):
            mols = sources.prior_from_column(mols, prior, s.unassigned_prior_label, least)
            estimate = knn.scale_from_assignment(mols, d.min_molecules_per_cell, "prior_segmentation", dims) if s.estimate_scale_from_centers else None
        else:
            mask = sources.read_mask(spark, prior)
            mols = raster.lookup(mols, mask)
            estimate = raster.mask_scale(mask) if s.estimate_scale_from_centers else None
        if estimate is not None:
            scale, scale_std = estimate.first()
    mols = cut(noise.append_confidence(mols, d.confidence_nn_id or more.confidence_nn_id, s.prior_segmentation_confidence, dims), "confidence")
    edges = cut(graph.neighbour_graph(mols, dims).select("src", "dst", "weight"), "edges")
    if s.nuclei_genes:
        raw = graph.neighbour_graph(mols, dims, keep_long=True)
        found = clusters.compartments(mols, raw, _genes(spark, s.nuclei_genes), _genes(spark, s.cyto_genes), scale, dims=dims)
        mols = cut(mols.join(found, "molecule_id"), "compartments")
    changes: list[float] = []
    if s.n_clusters > 1:
        raw = cut(graph.neighbour_graph(mols, dims, keep_long=True).select("src", "dst", "weight"), "edges")
        found, changes = clusters.cluster_molecules(mols, raw, s.n_clusters)
        mols = cut(mols.join(found.select("molecule_id", "cluster"), "molecule_id"), "clusters")
    settings = segmentation.Settings(scale, scale_std, d.min_molecules_per_cell, s.prior_segmentation_confidence, dims, seed, history_depth=round(0.1 * s.iters))
    start = segmentation.initial_cells(mols, s.n_cells_init or more.n_cells_init, settings)
    out = segmentation.segment(mols, edges, start, s.iters, settings)
    joined = cut(mols.join(out["assigned"], "molecule_id"), "segmented")
    life = aggregates.lifespan(out["history"], s.iters).join(out["cells"].select("guid", "cell"), "guid").select("cell", "lifespan") if "history" in out else None
    cells = cut(qc.cell_table(joined, dims=dims, lifespans=life), "cells")
    vectors = ncv.composition_vectors(mols, more.composition_neighborhood, dims)
    colour = ncv.colours(_vectors(ncv.log_values(cut(vectors, "ncv")), 20)).select("molecule_id", "ncv_color")
    table = qc.molecule_table(joined.join(colour, "molecule_id", "left"), run_id, "history" in out)
    results = {"molecules": table, "cells": cells, "counts": aggregates.count_matrix(joined), "polygons": polygons.polygons_by_z(joined), "trace": out["trace"]}
    sinks.save_results(results, paths, count_matrix, polygon_format, run_id)
    if plot:
        sinks.save_text(paths.diagnostics, reports.diagnostics_page(joined, cells, out["trace"], changes))
        sinks.save_text(paths.report, reports.scatter_page(table, "ncv_color"))
    return results


def _vectors(composition: DataFrame, n: int) -> DataFrame:
    composition = cut(composition, "composition")
    return ncv.molecule_vectors(composition, cut(ncv.gene_vectors(ncv.coexpression(composition), n), "genes"))


def preview(spark: SparkSession, coordinates: str, options: RunOptions, output: str = "preview.html") -> str:
    mols, genes = sources.load_molecules(spark, coordinates, options.data)
    mols = cut(mols, "molecules")
    dims = tuple(c for c in ("x", "y", "z") if c in mols.columns)
    more = derive(options.data.min_molecules_per_cell, genes.count(), mols.count())
    nn = options.data.confidence_nn_id or more.confidence_nn_id
    mols = cut(noise.append_confidence(mols, nn, dims=dims), "confidence")
    far = knn.knn(mols, nn + 1, None, dims).groupBy("src").agg(F.max("dist").alias("d"))
    edges = graph.neighbour_graph(mols, dims, keep_long=True)
    html = reports.preview_page(mols, far, ncv.gene_structure(aggregates.cooccurrence(edges, mols), mols))
    sinks.save_text(output, html)
    return html


def segfree(spark: SparkSession, coordinates: str, options: RunOptions, k: int = 0, output: str = "ncvs") -> None:
    mols, genes = sources.load_molecules(spark, coordinates, options.data)
    mols = cut(mols, "molecules")
    dims = tuple(c for c in ("x", "y", "z") if c in mols.columns)
    more = derive(options.data.min_molecules_per_cell, genes.count(), mols.count())
    if not k and options.data.min_molecules_per_cell <= 0:
        raise ValueError("either min_molecules_per_cell or k is needed")
    vectors = cut(ncv.composition_vectors(mols, k or more.composition_neighborhood, dims), "ncv")
    mols = noise.append_confidence(mols, options.data.confidence_nn_id or more.confidence_nn_id, dims=dims)
    colour = ncv.colours(_vectors(vectors, 30)).select("molecule_id", "ncv_color")
    name = F.concat(F.lit(f"VR{uuid.uuid4().hex[:9]}-"), F.col("molecule_id").cast("string"))
    attrs = mols.join(colour, "molecule_id").select(name.alias("Name"), "ncv_color", "confidence")
    sinks.save_counts_table(vectors.select("gene", F.col("molecule_id").alias("cell"), F.col("v").alias("n")), attrs, genes, output)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spotweave", description=__doc__)
    p.add_argument("command", choices=["run", "preview", "segfree"])
    p.add_argument("coordinates")
    p.add_argument("prior", nargs="?")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--min-molecules-per-cell", type=int)
    p.add_argument("-s", "--scale", type=float)
    p.add_argument("--scale-std")
    p.add_argument("--n-clusters", type=int)
    p.add_argument("--iters", type=int)
    p.add_argument("--prior-segmentation-confidence", type=float)
    p.add_argument("-x", "--x-column", dest="x")
    p.add_argument("-y", "--y-column", dest="y")
    p.add_argument("-z", "--z-column", dest="z")
    p.add_argument("-g", "--gene-column", dest="gene")
    p.add_argument("-k", "--k-neighbors", type=int, default=0)
    p.add_argument("--count-matrix-format", default="tsv")
    p.add_argument("--polygon-format", default="FeatureCollection")
    p.add_argument("--plot", action="store_true")
    a = p.parse_args(argv)
    names = ("min_molecules_per_cell", "scale", "scale_std", "n_clusters", "iters", "prior_segmentation_confidence", "x", "y", "z", "gene")
    options = load_options(a.config, **{n: getattr(a, n) for n in names})
    spark = SparkSession.builder.appName("spotweave").getOrCreate()
    if a.command == "run":
        run(spark, a.coordinates, options, a.prior, a.output or "segmentation.csv", a.count_matrix_format, a.polygon_format, a.plot)
    elif a.command == "preview":
        preview(spark, a.coordinates, options, a.output or "preview.html")
    else:
        segfree(spark, a.coordinates, options, a.k_neighbors, a.output or "ncvs")


if __name__ == "__main__":
    main()
