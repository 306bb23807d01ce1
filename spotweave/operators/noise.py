"""Confidence of molecules: two normals over neighbour distances, smoothed on the graph while fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.scalar import normal_pdf
from ..functions.shared import cut, forget
from .aggregates import weighted_mean, weighted_sd
from .graph import neighbour_graph
from .knn import knn


def fit_noise(dist: DataFrame, edges: DataFrame, prior: DataFrame | None = None, tolerance: float = 0.005, most: int = 10_000) -> tuple[DataFrame, dict]:
    """molecule_id, confidence, assignment (1 real, 2 noise), and the fit.  dist: molecule_id, d; edges: symmetric
    src, dst, weight; prior: molecule_id, prior in [0, 1].

    All molecules are updated at once in each step.  The final probabilities leave the neighbours out."""
    lo, hi = quantiles(dist, "d", [0.1, 0.9])
    sd = (hi - lo) / 4 or 1e-10
    fit = {"mean1": lo, "sd1": sd, "mean2": hi, "sd2": sd, "n1": 0.0, "n2": 0.0}
    border = hi + 3 * sd
    d, out = F.col("d"), F.col("d") > border
    base = dist if prior is None else dist.join(prior, "molecule_id", "left")
    shift = F.lit(0.0) if prior is None else F.coalesce("prior", F.lit(0.0))
    a, b = normal_pdf(d, lo, sd), F.when(out, 1.0).otherwise(normal_pdf(d, hi, sd))
    state = cut(base.select("molecule_id", "d", shift.alias("c"), (a / F.greatest(a + b, F.lit(1e-20))).alias("p")), "noise")

    def moments(df):
        r = df.where(~out).agg(F.sum("p"), weighted_mean(d, F.col("p")), weighted_sd(d, F.col("p")), F.sum(1 - F.col("p")), weighted_mean(d, 1 - F.col("p")), weighted_sd(d, 1 - F.col("p"))).first()
        floor = lambda v: max(v or 0.0, 1e-10)
        return {"n1": r[0] or 0.0, "mean1": r[1] if r[1] is not None else fit["mean1"], "sd1": floor(r[2]), "n2": r[3] or 0.0, "mean2": r[4] if r[4] is not None else fit["mean2"], "sd2": floor(r[5])}

    fit = fit | moments(state)
    for _ in range(most):
        near = edges.join(state.select(F.col("molecule_id").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("molecule_id")).agg(F.sum(F.col("weight") * F.col("p")).alias("s1"), F.sum(F.col("weight") * (1 - F.col("p"))).alias("s2"))
        joined = state.drop("p").join(near, "molecule_id", "left")
        d1 = F.lit(fit["n1"]) * F.exp(F.coalesce("s1", F.lit(0.0))) * normal_pdf(d, fit["mean1"], fit["sd1"])
        d2 = F.lit(fit["n2"]) * F.exp(F.coalesce("s2", F.lit(0.0))) * normal_pdf(d, fit["mean2"], fit["sd2"])
        p = F.when(out, 0.0).otherwise(d1 / F.greatest(d1 + d2, F.lit(1e-20)))
        old, state = state, cut(joined.select("molecule_id", "d", "c", (F.col("c") + p * (1 - F.col("c"))).alias("p")), "noise")
        forget(old)
        new = moments(state)
        change = max(abs(new[k] - fit[k]) / max(abs(fit[k]), 1e-10) for k in ("mean1", "sd1", "mean2", "sd2"))
        fit = fit | new
        if change < tolerance:
            break
    if fit["mean1"] > fit["mean2"]:
        fit |= {"mean1": fit["mean2"], "mean2": fit["mean1"], "sd1": fit["sd2"], "sd2": fit["sd1"]}
    d1, d2 = fit["n1"] * normal_pdf(d, fit["mean1"], fit["sd1"]), fit["n2"] * normal_pdf(d, fit["mean2"], fit["sd2"])
    p = F.when(out, 0.0).otherwise(d1 / F.greatest(d1 + d2, F.lit(1e-20)))
    p = F.col("c") + p * (1 - F.col("c"))
    return state.select("molecule_id", p.alias("confidence"), F.when(1 - p > 0.5, 2).otherwise(1).alias("assignment")), fit


def append_confidence(molecules: DataFrame, nn_id: int, prior_confidence: float = 0.5, dims: tuple = ("x", "y"), adjacency: str = "auto", most: int = 10_000) -> DataFrame:
    """molecules with confidence, from the distance to the nn_id-th neighbour; a prior segmentation raises it."""
    dist = cut(knn(molecules, nn_id + 1, None, dims).groupBy("src").agg(F.max("dist").alias("d")).withColumnRenamed("src", "molecule_id"), "distances")
    edges = cut(neighbour_graph(molecules, dims, adjacency, keep_long=True).select("src", "dst", "weight"), "edges")
    prior = None
    if "prior_segmentation" in molecules.columns:
        prior = molecules.select("molecule_id", F.when(F.col("prior_segmentation") > 0, prior_confidence**2).otherwise(0.0).alias("prior"))
    found, _ = fit_noise(dist, edges, prior, most=most)
    return molecules.drop("confidence").join(found.select("molecule_id", "confidence"), "molecule_id")
