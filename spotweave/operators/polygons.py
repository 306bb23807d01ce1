"""Boundary polygons of cells."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import border_edges, delaunay, peel, ring_of
from ..functions.quantiles import quantiles
from .knn import knn
from .ranges import bounding_boxes, points_in_boxes

log = logging.getLogger(__name__)
RING = "array<struct<x:double,y:double>>"


def ring(own: np.ndarray, foreign: np.ndarray, offset: float) -> list[tuple[float, float]]:
    """The border of a cell's molecules, open; foreign: others inside their box."""
    pts = np.unique(np.asarray(own, float), axis=0)
    if len(pts) == 1:
        x, y = pts[0].tolist()
        return [(x + offset, y), (x - offset, y), (x, y + offset), (x, y - offset)]
    if len(pts) == 2:
        (ax, ay), (bx, by) = pts.tolist()
        mx, my = (ax + bx) / 2, (ay + by) / 2
        return [(ax, ay), (mx + offset, my), (bx, by), (mx - offset, my)]
    tri = delaunay(pts)
    order = ring_of(peel(pts, tri, np.asarray(foreign, float).reshape(-1, 2)))
    return [tuple(pts[i].tolist()) for i in order]


def boundary_polygons(molecules: DataFrame, cell: str = "cell", group: str | None = None) -> DataFrame:
    """[group,] cell, ring: one polygon for each cell that has one."""
    if molecules.count() < 3:
        return molecules.sparkSession.createDataFrame([], f"cell int, ring {RING}")
    spacing = knn(molecules, 2).where("rank = 2").agg(F.avg("dist")).first()[0] or 1.0
    offset = 0.01 * spacing
    keys = ["cell"] if group is None else [group, "cell"]
    m = molecules.select("molecule_id", "x", "y", F.col(cell).cast("int").alias("cell"), *([group] if group else []))
    named = m if group is None else m.withColumn("_box", F.concat_ws("\n", F.col(group).cast("string"), F.col("cell").cast("string")))
    box_key = "cell" if group is None else "_box"
    boxes = bounding_boxes(named, "cell") if group is None else named.where("cell > 0").groupBy("_box", group, "cell").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    at = m.select("molecule_id", "x", "y", F.col("cell").alias("own"), *([F.col(group).alias("own_group")] if group else []))
    inside = points_in_boxes(at, boxes, box=box_key, keep=tuple(at.columns[1:]))  # the points bring their own cells along
    if group:
        inside = inside.join(boxes.select("_box", group, "cell"), "_box").where(F.col("own_group") == F.col(group))
    inside = inside.select(*keys, "x", "y", (F.col("own") == F.col("cell")).alias("mine"))
    kinds = dict(inside.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ring {RING}"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["mine"].to_numpy()
        xy = pdf[["x", "y"]].to_numpy()
        found = ring(xy[mine], xy[~mine], offset)
        if not found:
            return pd.DataFrame(columns=[*keys, "ring"], dtype=object)  # columns of numbers can't be read as rings
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ring": [[{"x": x, "y": y} for x, y in found]]})

    return inside.groupBy(*keys).applyInPandas(one, schema)


def polygons_by_z(molecules: DataFrame, most: int = 10) -> DataFrame:
    """z (its value, its bin, or "2d"), cell, ring.  More than ten values of z fall into ten bins between two
    quantiles; the outer bins take what lies beyond."""
    flat = boundary_polygons(molecules).select(F.lit("2d").alias("z"), "cell", "ring")
    if "z" not in molecules.columns:
        return flat
    values = [r[0] for r in molecules.select("z").distinct().limit(most + 1).collect()]
    name = F.col("z").cast("double").cast("string")
    if len(values) > most:
        log.warning("too many values of z: %d bins are used", most)
        clip = min(1 / most / 4, 0.025)
        lo, hi = quantiles(molecules, "z", [clip, 1 - clip])
        width = (hi - lo) / most or 1.0
        name = F.concat(F.lit("bin"), F.least(F.greatest(F.floor((F.col("z") - lo) / width), F.lit(0)), F.lit(most - 1)).cast("string"))
    each = boundary_polygons(molecules.withColumn("z", name), group="z")
    return flat.union(each.select("z", "cell", "ring"))


def label_polygons(mask: DataFrame) -> DataFrame:
    """cell, ring of each label of a raster: the outer border of the triangulated border pixels."""
    from pyspark.sql import Window

    m = mask.where("label > 0")
    near = [m.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "label") for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    around = near[0].union(near[1]).union(near[2]).union(near[3]).groupBy("row", "col", "label").agg(F.count("*").alias("same"))
    edge = m.join(around, ["row", "col", "label"], "left").where("coalesce(same, 0) < 4")
    edge = edge.withColumn("_n", F.count("*").over(Window.partitionBy("label"))).where("_n > 2")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[["col", "row"]].to_numpy(float)
        tri = delaunay(pts)
        order = ring_of([e for e, t in border_edges([tuple(t) for t in tri.tolist()]).items() if len(t) == 1])
        ring_ = [{"x": float(pts[i, 0]), "y": float(pts[i, 1])} for i in order]
        return pd.DataFrame({"cell": [int(pdf["label"].iloc[0])], "ring": [ring_]}) if ring_ else pd.DataFrame(columns=["cell", "ring"], dtype=object)

    return edge.groupBy("label").applyInPandas(one, f"cell int, ring {RING}")
