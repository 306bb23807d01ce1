"""Boxes, triangles and the points in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles


def bounding_boxes(df: DataFrame, cell: str = "cell", dims: tuple = ("x", "y")) -> DataFrame:
    return df.where(F.col(cell) > 0).groupBy(cell).agg(*(f(d).alias(f"{d}_{m}") for d in dims for m, f in (("min", F.min), ("max", F.max))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, key: str = "molecule_id", box: str = "cell", keep: tuple = ()) -> DataFrame:
    """(box, key, and columns to keep) of every point in an inclusive box.  A grid as wide as a typical box turns the range join
    into an equi-join; a box is dealt to all grid squares that it touches."""
    size = quantiles(boxes, F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")), [0.9])[0]
    size = float(size or 0) or 1.0
    square = lambda c: F.floor(F.col(c) / size)
    b = boxes.withColumn("_i", F.explode(F.sequence(square("x_min"), square("x_max")))).withColumn("_j", F.explode(F.sequence(square("y_min"), square("y_max"))))
    b = b.select(F.col(box).alias("_box"), "x_min", "x_max", "y_min", "y_max", "_i", "_j")
    p = points.select(F.col(key), "x", "y", *(c for c in keep if c not in ("x", "y"))).withColumn("_i", square("x")).withColumn("_j", square("y"))
    return p.join(b, ["_i", "_j"]).where(F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))).select(F.col("_box").alias(box), key, *keep)


def in_triangle(x: Column, y: Column, ax, ay, bx, by, cx, cy) -> Column:
    """Barycentric test: u >= 0, v >= 0, u + v < 1."""
    d00 = (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)
    d01 = (cx - ax) * (bx - ax) + (cy - ay) * (by - ay)
    d11 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    d02 = (cx - ax) * (x - ax) + (cy - ay) * (y - ay)
    d12 = (bx - ax) * (x - ax) + (by - ay) * (y - ay)
    det = d00 * d11 - d01 * d01
    u, v = F.try_divide(d11 * d02 - d01 * d12, det), F.try_divide(d00 * d12 - d01 * d02, det)
    return F.coalesce((u >= 0) & (v >= 0) & (u + v < 1), F.lit(False))


def triangle_counts(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """triangle, n: points in each triangle (triangle, ax, ay, bx, by, cx, cy), by way of its box."""
    boxes = triangles.select("triangle", *(f(f"a{d}", f"b{d}", f"c{d}").alias(f"{d}_{m}") for d in "xy" for m, f in (("min", F.least), ("max", F.greatest))))
    near = points_in_boxes(points, boxes, box="triangle").join(points.select("molecule_id", "x", "y"), "molecule_id").join(triangles, "triangle")
    hit = near.where(in_triangle(F.col("x"), F.col("y"), *(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))))
    counts = hit.groupBy("triangle").agg(F.count("*").alias("n"))
    return triangles.select("triangle").join(counts, "triangle", "left").select("triangle", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
