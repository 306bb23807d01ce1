"""Operators on small fixtures, against brute force and plain numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import scalar
from spotweave.operators import aggregates, clusters, filters, graph, knn, ncv, noise, polygons, qc, ranges, raster, segmentation
from spotweave.options import DataOptions, derive, load_options, parse_scale_std, validate
from spotweave.sources import molecules as sources
from spotweave.sources import sinks


def uniform(spark, n=300, seed=0, genes=10, cells=0):
    rng = np.random.default_rng(seed)
    rows = [(i + 1, float(x), float(y), f"g{int(g)}", float(c)) for i, (x, y, g, c) in enumerate(zip(rng.random(n), rng.random(n), rng.integers(1, genes + 1, n), rng.random(n)))]
    df = spark.createDataFrame(rows, "molecule_id long, x double, y double, gene_name string, confidence double")
    if cells:
        df = df.withColumn("cell", (1 + F.floor(F.col("x") * cells)).cast("int"))
    return df, np.array([r[1:3] for r in rows])


def test_options(tmp_path):
    p = tmp_path / "o.toml"
    p.write_text('[Data]\nx = "x_location"\nmin_molecules_per_cell = 30\n[segmentation]\niters = 7\n')
    o = load_options(str(p), scale=5.0, iters=9)
    assert (o.data.x, o.data.min_molecules_per_cell, o.segmentation.scale, o.segmentation.iters) == ("x_location", 30, 5.0, 9)
    assert not validate(o, False).segmentation.estimate_scale_from_centers
    with pytest.raises(ValueError):
        validate(load_options(min_molecules_per_cell=10), False)
    with pytest.raises(ValueError):
        load_options(unknown=1)
    assert [parse_scale_std(v, 10.0) for v in (None, "25%", "3", 2)] == [2.5, 2.5, 3.0, 2.0]
    d = derive(10, 200, 1000)
    assert (d.min_molecules_per_segment, d.confidence_nn_id, d.composition_neighborhood, d.n_gene_pcs, d.n_cells_init) == (2, 6, 20, 66, 200)


def test_load(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("x,xx,y,z,gene,extra\n9,1.5,2,1,a,p\n9,0.5,3,1,b,q\n9,0.7,4,1,,r\n")
    df, genes = sources.load_molecules(spark, path, DataOptions(x="xx"))
    rows = df.orderBy("molecule_id").collect()
    assert [r.x for r in rows] == [0.5, 0.7, 1.5] and [r.gene_name for r in rows] == ["b", "missing", "a"]
    assert "z" not in df.columns and "x_reserved" in df.columns and "extra" in df.columns
    assert {(r.gene_name, r.gene) for r in genes.collect()} == {("a", 1), ("b", 2), ("missing", 3)}
    with pytest.raises(ValueError):
        sources.read_table(spark, "a.txt")
    assert sources.repeated_rows(df) == 0


def test_names(spark):
    df = spark.createDataFrame([(0,), (2,)], "cell int").select(scalar.cell_name(F.col("cell"), "RI").alias("n"), scalar.is_noise(F.col("cell"), "int").alias("z"))
    assert [tuple(r) for r in df.collect()] == [("", True), ("CRI-2", False)]


def test_regular_expressions_not_globs(spark):
    df = spark.createDataFrame([("Blan",), ("a",)], "gene_name string")
    assert [r[0] for r in filters.exclude_genes(df, "Blank*, none").collect()] == ["a"]


@pytest.mark.parametrize("m,left", [(0, {1, 2, 3, 4, 5, 7}), (2, {1, 2}), (3, {2}), (4, set())])
def test_small_segments(spark, m, left):
    grid = [1, 2, 3, 1, 2, 4, 5, 2, 7]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(grid)], "molecule_id long, prior_segmentation long")
    assert {r.prior_segmentation for r in filters.small_segments(df, m).collect()} - {0} == left


def test_knn_is_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 25)
    df, xy = uniform(spark, 400)
    got = {}
    for r in knn.knn(df, 6).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    want = np.argsort(d, axis=1, kind="stable")[:, :6] + 1
    assert all([x for _, x in sorted(got[i + 1])] == want[i].tolist() for i in range(400))


@pytest.mark.parametrize("seed", [4, 5])
def test_delaunay_edges(spark, seed):
    """All edges, those of the hull too, by empty circles: two points are joined if some circle through them, or through them
    and a third, holds no other."""
    df, xy = uniform(spark, 60, seed)
    found = {(r.src, r.dst) for r in graph.delaunay_edges(df).collect()}
    n, want = len(xy), set()
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                (ax, ay), (bx, by), (cx, cy) = xy[i], xy[j], xy[k]
                d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
                uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
                r2 = (ax - ux) ** 2 + (ay - uy) ** 2
                if (np.delete((xy[:, 0] - ux) ** 2 + (xy[:, 1] - uy) ** 2, [i, j, k]) > r2).all():
                    want |= {(i + 1, j + 1), (j + 1, k + 1), (i + 1, k + 1)}
    assert found == want


def test_delaunay_edges_beyond_the_most_neighbours(spark):
    """Two dense groups far apart: cells at their rims need points on the other side."""
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.random((150, 2)), rng.random((150, 2)) + [4, 0.3]])
    df = spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(xy)], "molecule_id long, x double, y double")
    edges = lambda **kw: {(r.src, r.dst) for r in graph.delaunay_edges(df, **kw).collect()}
    assert edges(k=8, most=24) == edges(k=300, most=300)


@pytest.mark.parametrize("kind", ["knn", "both", "auto"])
def test_graphs(spark, kind):
    df, _ = uniform(spark, 120)
    e = graph.neighbour_graph(df, adjacency=kind).toPandas()
    assert not e.duplicated(["src", "dst"]).any() and (e.src != e.dst).all() and e.weight.between(0, 1).all()
    with pytest.raises(ValueError):
        graph.neighbour_graph(df, adjacency="none")


def test_split_cells(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 0)], "molecule_id long, cell int")
    e = graph.symmetric(spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7)], "src long, dst long"))
    once = graph.split_cells(a, e)
    want = {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 2, 7: 0}
    assert {r.molecule_id: r.cell for r in once.collect()} == want
    assert {r.molecule_id: r.cell for r in graph.split_cells(once, e).collect()} == want


def test_polygons(spark):
    df, _ = uniform(spark, 200, 2, cells=4)
    rings = polygons.boundary_polygons(df).collect()
    assert {r.cell for r in rings} == {1, 2, 3, 4} and all(len(r.ring) > 3 for r in rings)
    assert [len(polygons.ring(np.array(p, float), np.zeros((0, 2)), 0.1)) for p in ([(0, 0)], [(0, 0), (1, 1)])] == [4, 4]
    text = json.loads(sinks.geojson(polygons.boundary_polygons(df)).first().geojson)
    assert text["type"] == "FeatureCollection" and [f["id"] for f in text["features"]] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        sinks.geojson(polygons.boundary_polygons(df), "shape")


def test_labels_of_mask(spark):
    mask = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (3, 3, 5), (3, 4, 5)], "row long, col long, label long")
    got = {(r.row, r.col): r.label for r in raster.label_parts(mask).collect()}
    assert got[1, 1] == got[1, 2] == 1 and got[3, 3] == got[3, 4] == 2


def test_composition_vectors(spark):
    df, _ = uniform(spark, 150)
    for kw, total in (({}, 1.0), ({"normalise": False, "by_distance": False}, 10.0)):
        sums = ncv.composition_vectors(df, 10, **kw).groupBy("molecule_id").agg(F.sum("v").alias("s")).toPandas()["s"]
        assert len(sums) == 150 and np.allclose(sums, total, atol=1e-4)


def test_noise_step_against_numpy(spark):
    rng = np.random.default_rng(0)
    d = np.concatenate([rng.normal(1, 0.2, 150), rng.normal(4, 0.7, 50)])
    dist = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(d)], "molecule_id long, d double")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    found, fit = noise.fit_noise(dist, none)
    conf = found.orderBy("molecule_id").toPandas()["confidence"].to_numpy()
    assert conf[:150].mean() > 0.9 and conf[150:].mean() < 0.1 and fit["mean1"] < fit["mean2"]


def test_clusters_find_two_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i + 1, float(rng.random() + 3 * (i % 2)), float(rng.random()), f"g{rng.integers(1, 4) + 3 * (i % 2)}", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "molecule_id long, x double, y double, gene_name string, confidence double")
    got, changes = clusters.cluster_molecules(df, graph.neighbour_graph(df, adjacency="knn", keep_long=True), 2, most=12)
    c = got.orderBy("molecule_id").toPandas()["cluster"].to_numpy()
    assert len(changes) == 12 and max((c[::2] == k).mean() + (c[1::2] == 3 - k).mean() for k in (1, 2)) > 1.8


def test_recovery(spark):
    """Synthetic cells are found again."""
    rng = np.random.default_rng(5)
    rows, scale = [], 0.2
    for cell, (x, y) in enumerate([(i * 2.0, j * 2.0) for i in range(3) for j in range(2)], 1):
        p = rng.dirichlet(np.ones(20) * 0.3)
        rows += [(float(rng.normal(x, scale)), float(rng.normal(y, scale)), f"g{rng.choice(20, p=p)}", cell) for _ in range(40)]
    m = spark.createDataFrame([(i + 1, *r, 0.95) for i, r in enumerate(rows)], "molecule_id long, x double, y double, gene_name string, true int, confidence double")
    s = segmentation.Settings(scale, scale / 4, 20, history_depth=2)
    mols = m.drop("true")
    out = segmentation.segment(mols, graph.neighbour_graph(mols, adjacency="knn"), segmentation.initial_cells(mols, 24, s), 5, s)
    both = out["assigned"].join(m, "molecule_id").where("cell > 0").toPandas()
    purity = both.groupby("cell")["true"].agg(lambda v: v.value_counts().iloc[0] / len(v))
    assert (purity >= 0.9).mean() > 0.8 and len(both) > 0.5 * len(rows)
    table = qc.cell_table(both_df(spark, both))
    assert table.count() == both["cell"].nunique()


def both_df(spark, pdf):
    return spark.createDataFrame(pdf[["molecule_id", "x", "y", "cell", "confidence", "assignment_confidence"]])


def test_box_contents(spark):
    df, xy = uniform(spark, 200, 7, cells=5)
    got = {(r.cell, r.molecule_id) for r in ranges.points_in_boxes(df, ranges.bounding_boxes(df)).collect()}
    own = {(r.cell, r.molecule_id) for r in df.collect()}
    assert own <= got


def test_scale_needs_three_cells(spark):
    df, _ = uniform(spark, 30, cells=2)
    with pytest.raises(ValueError):
        knn.scale_from_assignment(df, 1)


def test_counts_sum_to_one(spark):
    df, _ = uniform(spark, 100, cells=3)
    v = aggregates.sparse_counts(df, "cell", "gene_name", normalise=True).groupBy("cell").agg(F.sum("v").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in v)


def test_empty_tables(spark):
    df = uniform(spark, 10)[0].where("false").withColumn("cell", F.lit(1)).withColumn("prior_segmentation", F.lit(0).cast("long"))
    assert knn.knn(df, 3).count() == 0
    assert qc.cell_table(df).count() == 0
    assert aggregates.count_matrix(df).count() == 0
    assert filters.encode_genes(df)[0].count() == 0
    assert polygons.boundary_polygons(df).count() == 0
