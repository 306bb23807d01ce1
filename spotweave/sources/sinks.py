"""Writers of results."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, save_file

log = logging.getLogger("spotweave")


@dataclass
class OutputPaths:
    segmentation: str
    cells: str
    counts: str
    report: str
    diagnostics: str
    polygons_2d: str
    polygons_3d: str
    params: str
    log: str


def with_suffix(path: str, name: str) -> str:
    """stem_name.ext"""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{name}{ext}"


def output_paths(output: str) -> OutputPaths:
    """All paths from that of the segmentation table; a folder gets segmentation.csv."""
    if os.path.isdir(output) or output.endswith("/"):
        output = os.path.join(output, "segmentation.csv")
    stem = os.path.splitext(output)[0]
    named = lambda n, ext: f"{stem}_{n}.{ext}"
    return OutputPaths(output, named("cell_stats", "csv"), named("counts", "tsv"), named("borders", "html"), named("diagnostics", "html"), named("polygons_2d", "json"), named("polygons_3d", "json"), named("params.dump", "toml"), named("log", "log"))


def save_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    (df.orderBy(order) if order else df).write.mode("overwrite").csv(path, header=True)


def wide_counts(counts: DataFrame) -> DataFrame:
    """gene and one column for each cell, zeros written, for few cells; ``save_counts_tsv`` writes any number."""
    return counts.groupBy("gene").pivot("cell").agg(F.sum("n")).na.fill(0)


def save_counts_tsv(counts: DataFrame, path: str) -> None:
    """gene and one field for each cell, in lines; any number of cells, as no column stands for one."""
    cells = counts.select("cell").distinct().agg(F.array_sort(F.collect_list("cell")).alias("cells"))  # one number for each cell
    head = cells.select(F.lit(0).alias("k"), F.lit("").alias("gene"), F.concat(F.lit("gene\t"), F.array_join(F.transform("cells", lambda c: c.cast("string")), "\t")).alias("value"))
    # a line's counts by the places of their cells, with zeros for the gaps between: in proportion to the line
    places = cells.select(F.posexplode("cells").alias("at", "cell"))
    placed = counts.join(places, "cell").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("n").cast("string"), F.lit("0")).alias("n")))).alias("n"))
    rows = placed.crossJoin(cells.select(F.size("cells").alias("all")))  # cells: one row
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("n", i - 1)["at"])
    text = F.array_join(F.transform("n", lambda x, i: F.concat(F.repeat(F.lit("\t0"), x["at"] - before(i) - 1), F.lit("\t"), x["n"])), "")
    rest = F.repeat(F.lit("\t0"), F.col("all") - 1 - F.element_at("n", -1)["at"])
    lines = rows.select(F.lit(1).alias("k"), "gene", F.concat(F.col("gene"), text, rest).alias("value"))
    head.union(lines).orderBy("k", "gene").select("value").write.mode("overwrite").text(path)


def read_counts_tsv(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell, n of a written matrix."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    head = rows.where(F.col("f")[0] == "gene").select(F.col("f").alias("h"))
    cell = F.explode(F.arrays_zip(F.slice("h", 2, F.size("h") - 1).alias("c"), F.slice("f", 2, F.size("f") - 1).alias("n")))
    long = rows.where(F.col("f")[0] != "gene").crossJoin(head).select(F.col("f")[0].alias("gene"), cell.alias("x"))  # head: one row
    return long.select("gene", F.col("x.c").cast("long").alias("cell"), F.col("x.n").cast("double").alias("n")).where("n != 0")


def save_counts_table(counts: DataFrame, cells: DataFrame, genes: DataFrame, path: str, attributes: dict | None = None) -> None:
    """What a Loom file holds, as Parquet: matrix, row_attrs (Name), col_attrs (CellID and all columns of cells),
    attrs.  (Loom itself needs an HDF5 library, which isn't at hand.)"""
    spark = counts.sparkSession
    counts.write.mode("overwrite").parquet(f"{path}/matrix")
    genes.write.mode("overwrite").parquet(f"{path}/row_attrs")
    cells.withColumn("CellID", F.col(cells.columns[0])).write.mode("overwrite").parquet(f"{path}/col_attrs")
    spark.createDataFrame([(k, str(v)) for k, v in ({"LOOM_SPEC_VERSION": "3.0.0"} | (attributes or {})).items()], "name string, value string").write.mode("overwrite").parquet(f"{path}/attrs")


def geojson_parts(polygons: DataFrame, kind: str = "FeatureCollection", run_id: str | None = None) -> DataFrame:
    """[z,] cell, part: each polygon's text.  FeatureCollection leaves out rings of at most three vertices;
    GeometryCollectionLegacy has numbers for cells."""
    low = kind.lower()
    if low not in ("featurecollection", "geometrycollection", "geometrycollectionlegacy"):
        raise ValueError(f"unknown polygon format: {kind}")
    cell = F.col("cell") if low.endswith("legacy") or run_id is None else F.concat(F.lit(f"C{run_id}-"), F.col("cell").cast("string"))
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    keys = ["z"] if "z" in polygons.columns else []
    if low == "featurecollection":
        part = F.struct(F.lit("Feature").alias("type"), cell.alias("id"), shape.alias("geometry"))
        polygons = polygons.where(F.size("ring") > 3)
    else:
        part = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"), cell.alias("cell"))
    return polygons.select(*keys, "cell", F.to_json(part).alias("part"))


def _ends(kind: str) -> tuple[str, str]:
    name, field = ("FeatureCollection", "features") if kind.lower() == "featurecollection" else ("GeometryCollection", "geometries")
    return f'{{"type":"{name}","{field}":[', "]}"


def geojson(polygons: DataFrame, kind: str = "FeatureCollection", run_id: str | None = None) -> DataFrame:
    """[z,] geojson: one text for each z, or for all, for few polygons; ``save_polygons`` writes any number."""
    keys = ["z"] if "z" in polygons.columns else []
    parts = geojson_parts(polygons, kind, run_id).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "part"))).alias("f"))
    begin, end = _ends(kind)
    return parts.select(*keys, F.concat(F.lit(begin), F.array_join(F.transform("f", lambda x: x["part"]), ","), F.lit(end)).alias("geojson"))


def _pieces(parts: DataFrame, kind: str):
    """A collection's text, polygon by polygon: the driver holds one partition of them at a time."""
    begin, end = _ends(kind)
    yield begin
    for i, r in enumerate(parts.orderBy("cell").select("part").toLocalIterator()):
        yield ("," if i else "") + r.part
    yield end


def save_polygons(polygons: DataFrame, paths: OutputPaths, kind: str = "FeatureCollection", run_id: str | None = None) -> None:
    """The 2-D file, and for polygons by z a file that maps each z to its collection."""
    spark = polygons.sparkSession
    parts = cut(geojson_parts(polygons, kind, run_id), "polygons")
    if "z" not in polygons.columns:
        save_file(spark, paths.polygons_2d, _pieces(parts, kind))
        return
    save_file(spark, paths.polygons_2d, _pieces(parts.where("z = '2d'"), kind))
    values = sorted(r.z for r in parts.where("z != '2d'").select("z").distinct().collect())  # a few bins of z

    def by_z():
        yield "{"
        for i, z in enumerate(values):
            yield ("," if i else "") + json.dumps(z) + ":"
            yield from _pieces(parts.where(F.col("z") == z), kind)
        yield "}"

    save_file(spark, paths.polygons_3d, by_z())


def save_text(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def set_up_log(path: str) -> logging.Logger:
    """Messages to the console and, with time and level, to a file; warnings name their place."""

    class Lines(logging.Formatter):
        def format(self, r):
            where = f" ({r.pathname}:{r.lineno})" if r.levelno >= logging.WARNING else ""
            return f"[{self.formatTime(r, '%H:%M:%S')}] {r.levelname}: {r.getMessage()}{where}"

    log.setLevel(logging.INFO)
    for h in (logging.StreamHandler(), logging.FileHandler(path)):
        h.setFormatter(Lines())
        log.addHandler(h)
    return log


def save_results(results: dict, paths: OutputPaths, matrix: str = "tsv", polygon_format: str = "FeatureCollection", run_id: str = "R") -> None:
    """Everything that a run makes: molecules, cells, counts and polygons."""
    if matrix not in ("tsv", "loom", "parquet"):
        raise ValueError(f"unknown count matrix format: {matrix}")
    save_csv(results["molecules"], paths.segmentation, "molecule_id")
    save_csv(results["cells"], paths.cells, "cell")
    if matrix == "tsv":
        save_counts_tsv(results["counts"], paths.counts)
    else:
        save_counts_table(results["counts"], results["cells"], results["counts"].select("gene").distinct(), os.path.splitext(paths.counts)[0] + "_loom")
    if results.get("polygons") is not None and polygon_format.lower() != "none":
        save_polygons(results["polygons"], paths, polygon_format, run_id)
