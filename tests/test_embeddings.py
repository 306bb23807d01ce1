"""Embeddings, clusters of vectors, quantiles and layouts against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import geometry, near
from spotweave.functions import quantiles as Q
from spotweave.operators import clusters, graph, knn, ncv, polygons, segmentation
from spotweave.sources import sinks


def vector_table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(5)


def test_pca_is_numpys(spark):
    x = np.random.default_rng(0).normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    got = ncv.pca(vector_table(spark, x), 3, "id").orderBy("id").collect()
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    want = c @ (v[:3] * np.sign(v[:3][np.arange(3), np.abs(v[:3]).argmax(1)])[:, None]).T
    assert np.allclose(np.array([r.vector for r in got]), want, atol=1e-8)
    assert ncv.pca(vector_table(spark, x).where("false"), 3, "id").count() == 0


def test_gaussian_clusters_find_planted_groups(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.3, size=(80, 4)) for m in (-4, 0, 4)])
    got = {r.id: r.cluster for r in clusters.gaussian_clusters(vector_table(spark, x), 3, key="id", vector="vector").collect()}
    groups = [[got[i] for i in range(80 * k, 80 * k + 80)] for k in range(3)]
    assert all(len(set(g)) == 1 for g in groups) or sum(max(np.bincount(g)) for g in groups) >= 0.9 * 160


def test_colours_of_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.2, size=(40, 8)) for m in (-3, 3)])
    got = ncv.colours(vector_table(spark, x), key="id").orderBy("id").collect()
    lab = np.array([[r.l, r.a, r.b] for r in got])
    assert all(len(r.ncv_color) == 7 and r.ncv_color[0] == "#" for r in got) and len(got) == 80
    assert (lab[:, 0] >= 10 - 1e-9).all() and (lab[:, 0] <= 90 + 1e-9).all() and (np.abs(lab[:, 1:]) <= 100 + 1e-9).all()
    inside = np.mean([np.linalg.norm(g - g.mean(0), axis=1).mean() for g in (lab[:40], lab[40:])])
    assert np.linalg.norm(lab[:40].mean(0) - lab[40:].mean(0)) > inside


def test_layout_keeps_near_genes_near():
    d = np.ones((20, 20))
    d[:10, :10] = d[10:, 10:] = 0.1
    np.fill_diagonal(d, 0)
    y = ncv.umap_layout(np.zeros((20, 1)), 2, neighbours=5, distances=d)
    gap = np.linalg.norm(y[:, None] - y[None], axis=2)
    assert gap[:10, 10:].mean() > 2 * (gap[:10, :10].mean() + gap[10:, 10:].mean()) / 2


def test_components_unmix_planted_sources():
    rng = np.random.default_rng(3)
    s = rng.uniform(-1, 1, size=(2, 4000))
    mix = np.array([[1.0, 0.4], [0.3, 1.0], [0.2, -0.7]])
    got = clusters.independent_components(mix @ s, 2)
    cos = np.abs((got / np.linalg.norm(got, axis=0)).T @ (mix / np.linalg.norm(mix, axis=0)))
    assert (cos.max(1) > 0.95).all() and set(cos.argmax(1)) == {0, 1}


@pytest.mark.parametrize("few", [100_000, 10])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=5000), rng.integers(0, 3, 5000).astype(float), np.ones(50), np.array([2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
        shares = [0.0, 0.1, 0.5, 0.987, 1.0]
        want = df.agg(F.percentile("v", shares)).first()[0]
        assert Q.quantiles(df, "v", shares) == want
    assert Q.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("dims", [("x",), ("x", "y"), ("x", "y", "z")])
def test_neighbours_over_many_tiles(spark, monkeypatch, dims):
    """Dense groups, gaps, equal points and queries far outside, with tiles of few points."""
    monkeypatch.setattr(knn, "TILE", 12)
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(size=(150, 3)), rng.normal(50, 0.01, size=(100, 3)), np.ones((30, 3)), rng.uniform(-100, 100, size=(40, 3))])
    q = np.concatenate([p[::7], rng.uniform(-300, 300, size=(20, 3))])
    table = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "molecule_id long, x double, y double, z double")
    got = knn.knn(table(p), 5, table(q), dims).collect()
    n = len(dims)
    for i, r in enumerate(q):
        d = np.sqrt(((p[:, :n] - r[:n]) ** 2).sum(1))
        want = np.lexsort((np.arange(len(p)), d))[:5].tolist()
        assert [x.dst for x in sorted((x for x in got if x.src == i), key=lambda x: x.rank)] == want


def test_label_polygons_go_round_their_pixels(spark):
    rows = [(r, c, 1 if c < 6 else 2) for r in range(8) for c in range(12) if c != 6]
    got = {r.cell: [(p.x, p.y) for p in r.ring] for r in polygons.label_polygons(spark.createDataFrame(rows, "row long, col long, label long")).collect()}
    assert set(got) == {1, 2}
    for cell, (lo, hi) in {1: (0, 5), 2: (7, 11)}.items():
        xs, ys = zip(*got[cell])
        area = abs(sum(a * d - b * c for (a, b), (c, d) in zip(got[cell], got[cell][1:] + got[cell][:1]))) / 2
        assert (min(xs), max(xs), min(ys), max(ys)) == (lo, hi, 0, 7) and area == (hi - lo) * 7


def test_labels_and_cells_in_a_line_have_no_polygon(spark):
    line, block = [(0, c, 1) for c in range(5)], [(r, c, 2) for r in range(2, 5) for c in range(3)]
    mask = lambda rows: spark.createDataFrame(rows, "row long, col long, label long")
    assert [r.cell for r in polygons.label_polygons(mask(line + block)).collect()] == [2]
    assert polygons.label_polygons(mask(line)).collect() == []
    points = [(i, float(c), float(r), cell) for i, (r, c, cell) in enumerate(line + block)]
    cells = spark.createDataFrame(points, "molecule_id long, x double, y double, cell int")
    assert [r.cell for r in polygons.boundary_polygons(cells).collect()] == [2]


def test_parts_of_long_chains():
    """Components of random edges and of a chain in random order, against a search."""
    rng = np.random.default_rng(6)
    chain = rng.permutation(3000)
    for n, a, b in ((3000, chain[:-1], chain[1:]), (2000, rng.integers(0, 2000, 1200), rng.integers(0, 2000, 1200))):
        near = {}
        for x, y in zip(a.tolist(), b.tolist()):
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        want = [-1] * n
        for i in range(n):
            todo = [i] if want[i] < 0 else []
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = i
                    todo += near.get(j, [])
        assert graph.parts(n, a, b).tolist() == want


def test_neighbours_in_many_dimensions_by_blocks(spark, monkeypatch):
    """Blocks of queries and points, with equal points and equal distances."""
    monkeypatch.setattr(knn, "TILE", 12)
    monkeypatch.setattr(knn, "BLOCK", 40)
    p = np.concatenate([np.random.default_rng(8).normal(size=(90, 6)), np.ones((30, 6))])
    dims = tuple("abcdef")
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "molecule_id long, " + ", ".join(f"{d} double" for d in dims))
    got = knn.knn(table, 4, None, dims).toPandas().sort_values(["src", "rank"])
    d = sum((p[:, None, a] - p[None, :, a]) ** 2 for a in range(6))
    assert got["dst"].to_numpy().reshape(-1, 4).tolist() == np.argsort(d, axis=1, kind="stable")[:, :4].tolist()


def test_stars_of_dense_groups():
    """Groups of points nearly on one place: as many edges and triangles as a triangulation has."""
    rng = np.random.default_rng(9)
    p = np.repeat(rng.random((8, 2)), 40, 0) + (rng.random((320, 2)) - 0.5) * 2e-5
    src, dst, sure = near.stars(p, np.arange(len(p)), np.full(len(p), np.inf), (-1000, -1000, 1000, 1000))
    tri, hull = geometry.delaunay(p), len(geometry.convex_hull(p)) - 1
    edges = {(min(t[i], t[j]), max(t[i], t[j])) for t in tri.tolist() for i, j in ((0, 1), (1, 2), (0, 2))}
    assert len(tri) == 2 * len(p) - 2 - hull
    for i in np.flatnonzero(sure):
        assert set(dst[src == i].tolist()) == {a + b - i for a, b in edges if i in (a, b)}
    assert sure.sum() > 250


def test_edges_meet_histories_once(spark, monkeypatch):
    h = spark.createDataFrame([(i, m, g) for i, g1, g2 in ((1, 5, 5), (2, 5, 6), (3, 0, 0)) for m, g in ((1, g1), (2, g2))], "iter int, molecule_id long, guid long")
    found = segmentation.co_assignment(h, spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "src long, dst long"))
    assert sorted((r.src, r.dst, r.share) for r in found.collect()) == [(1, 2, 1 / 3), (2, 1, 1 / 3)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("iter" in line for line in joins)
    monkeypatch.setattr(segmentation, "MOLECULES", 1)
    monkeypatch.setattr(segmentation, "MAX_SENT", 0)
    best = segmentation.by_history(h, spark.createDataFrame([(5,)], "guid long"), spark.createDataFrame([(m,) for m in range(1, 8)], "molecule_id long"))
    assert {r.molecule_id: (r.guid, r.assignment_confidence) for r in best.collect()} == {1: (5, 2 / 3), 2: (0, 1 / 3)} | {m: (0, 0.0) for m in range(3, 8)}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression [molecule_id" in line and line.rstrip().endswith(", 7") for line in plan.splitlines()) == 2


def test_lengths_and_strong_edges_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, what, real=graph.cut: written.append(what) or real(df, what))
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.1)], "src long, dst long, weight double")
    probs = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5)], "molecule_id long, nucleus double, cyto double")
    assert [r.src for r in graph.damp_compartments(edges, probs, True, 0.5).collect()] == [1] and written == ["strong"]
    assert graph.damp_compartments(edges, probs, True, 1.0).count() == 2


def test_counts_of_gaps(spark, tmp_path):
    rows = [("a", 3, 1.5), ("a", 90, 2.0), ("b", 7, 1.0), ("c", 1, 4.0), ("c", 3, 0.5)]
    sinks.save_counts_tsv(spark.createDataFrame(rows, "gene string, cell long, n double"), f"{tmp_path}/c.tsv")
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/c.tsv").collect()]
    assert lines == [["gene", "1", "3", "7", "90"], ["a", "0", "1.5", "0", "2.0"], ["b", "0", "0", "1.0", "0"], ["c", "4.0", "0.5", "0", "0"]]
    assert sorted(map(tuple, sinks.read_counts_tsv(spark, f"{tmp_path}/c.tsv").collect())) == sorted(rows)
