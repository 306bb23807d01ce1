"""The three commands on a small set of molecules, and the files that they leave."""

import csv
import glob
import json
import tomllib

import numpy as np
import pytest

from spotweave import cli
from spotweave.options import load_options
from spotweave.sources import sinks


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    centres = [(x, y) for x in (0, 40, 80) for y in (0, 40)]
    rows = [(float(cx + dx), float(cy + dy), f"g{k % 3 * 3 + int(rng.integers(3))}", k + 1) for k, (cx, cy) in enumerate(centres) for dx, dy in rng.normal(0, 4, size=(45, 2))]
    path = str(tmp_path_factory.mktemp("points") / "molecules.csv")
    sinks.save_csv(spark.createDataFrame(rows, "x double, y double, gene string, nucleus int"), path)
    return path


def rows_of(folder, sep=","):
    out = []
    for p in sorted(glob.glob(f"{folder}/part-*")):
        with open(p, newline="") as f:
            out += list(csv.reader(f, delimiter=sep))
    return out


def test_run(spark, points, tmp_path):
    options = load_options(None, min_molecules_per_cell=10, scale=6.0, iters=3, n_clusters=2)
    cli.run(spark, points, options, ":nucleus", str(tmp_path) + "/out.csv", plot=True)
    table = rows_of(tmp_path / "out.csv")
    head = table[0]
    molecules = [dict(zip(head, r)) for r in table if r != head]
    assert len(molecules) == 270 and {"molecule_id", "x", "y", "cell", "is_noise", "confidence", "ncv_color"} <= set(head)
    assert all((m["cell"] == "") == (m["is_noise"] == "true") for m in molecules)
    counts = rows_of(tmp_path / "out_counts.tsv", "\t")
    assert counts[0][0] == "gene" and all(len(r) == len(counts[0]) for r in counts)
    assert sum(int(x) for r in counts[1:] for x in r[1:]) == sum(m["cell"] != "" for m in molecules)
    cells = rows_of(tmp_path / "out_cell_stats.csv")
    named = {m["cell"] for m in molecules} - {""}
    assert len({tuple(r) for r in cells if r != cells[0]}) == len(named)
    shapes = json.loads((tmp_path / "out_polygons_2d.json").read_text())
    assert shapes["type"] == "FeatureCollection" and {f["id"] for f in shapes["features"]} <= {m for m in named}
    assert tomllib.loads((tmp_path / "out_params.dump.toml").read_text()) and (tmp_path / "out_log.log").read_text()
    assert "vegaEmbed" in (tmp_path / "out_diagnostics.html").read_text() and "vegaEmbed" in (tmp_path / "out_borders.html").read_text()


def test_preview(spark, points, tmp_path):
    html = cli.preview(spark, points, load_options(None, min_molecules_per_cell=10), str(tmp_path / "p.html"))
    assert "noise level" in html and (tmp_path / "p.html").read_text() == html


def test_segfree(spark, points, tmp_path):
    cli.segfree(spark, points, load_options(None, min_molecules_per_cell=10), 6, str(tmp_path / "ncvs"))
    matrix, attrs = spark.read.parquet(f"{tmp_path}/ncvs/matrix"), spark.read.parquet(f"{tmp_path}/ncvs/col_attrs")
    per = matrix.groupBy("cell").sum("n").collect()
    assert len(per) == 270 and all(abs(r[1] - 1) < 1e-9 for r in per) and attrs.count() == 270


def test_wide_matrices_are_lines(spark, tmp_path):
    """More cells than a pivot takes."""
    counts = spark.range(12_000).selectExpr("concat('g', id % 3) AS gene", "id AS cell", "1 AS n")
    sinks.save_counts_tsv(counts, str(tmp_path / "c.tsv"))
    back = sinks.read_counts_tsv(spark, str(tmp_path / "c.tsv"))
    assert back.count() == 12_000 and back.agg({"n": "sum"}).first()[0] == 12_000


def test_polygon_files(spark, tmp_path):
    square = lambda x: [(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (x, 1.0)]
    rows = [("2d", 1, square(0.0)), ("2d", 2, square(5.0)), ("0.0", 1, square(0.0)), ("1.0", 2, square(5.0)), ("1.0", 3, square(0.0)[:3])]
    df = spark.createDataFrame(rows, "z string, cell int, ring array<struct<x:double,y:double>>")
    for kind, field, n in (("FeatureCollection", "features", 1), ("GeometryCollection", "geometries", 2)):
        paths = sinks.output_paths(str(tmp_path / f"{kind}.csv"))
        sinks.save_polygons(df, paths, kind, "R")
        flat, deep = json.load(open(paths.polygons_2d)), json.load(open(paths.polygons_3d))
        assert flat["type"] == kind and len(flat[field]) == 2 and sorted(deep) == ["0.0", "1.0"] and len(deep["1.0"][field]) == n
        assert [r.geojson for r in sinks.geojson(df.where("z = '2d'").drop("z"), kind, "R").collect()] == [open(paths.polygons_2d).read()]
