import numpy as np
import pytest

from spotweave.functions import geometry as G


@pytest.mark.parametrize("points,area", [([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)], 1), ([(0, 0), (2, 0), (2, 1), (0, 1), (1, 0.2)], 2), ([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 2)], 4)])
def test_hull(points, area):
    ring = G.convex_hull(np.array(points))
    assert G.ring_area(ring) == pytest.approx(area)
    assert (ring[0] == ring[-1]).all()


def test_delaunay_has_empty_circles():
    rng = np.random.default_rng(1)
    pts = rng.uniform(size=(60, 2))
    tri = G.delaunay(pts)
    hull = len(G.convex_hull(pts)) - 1
    assert len(tri) == 2 * len(pts) - 2 - hull
    for t in tri:
        a, b, c = pts[t]
        m = np.linalg.inv(np.array([b - a, c - a]) * 2) @ np.array([b @ b - a @ a, c @ c - a @ a])
        r = ((a - m) ** 2).sum()
        assert (((pts - m) ** 2).sum(1) > r - 1e-9).all()


def test_voronoi_neighbours_are_delaunay_edges():
    rng = np.random.default_rng(2)
    pts = rng.uniform(size=(80, 2))
    edges = {tuple(sorted((int(t[i]), int(t[j])))) for t in G.delaunay(pts) for i, j in ((0, 1), (1, 2), (0, 2))}
    found = set()
    for i, p in enumerate(pts):
        order = [j for j in np.argsort(((pts - p) ** 2).sum(1)) if j != i]
        near, _ = G.voronoi_neighbours(tuple(p), [tuple(pts[j]) for j in order], (-5, -5, 6, 6))
        found |= {tuple(sorted((i, int(order[k])))) for k in near}
    assert found <= edges and len(edges - found) < 12  # the frame leaves out the longest hull edges


def test_triangle():
    inside = np.random.default_rng(0).uniform(size=(20, 2))
    assert G.points_in_triangle(inside, (0, 0), (20, 0), (0, 20)).all()
    assert not G.points_in_triangle(np.array([[100.0, 100.0]]), (0, 0), (20, 0), (0, 20)).any()


@pytest.mark.parametrize("edges,n", [([(1, 2), (3, 1), (2, 3)], 4), ([(1, 2), (2, 3), (3, 4), (1, 4)], 5), ([(1, 2)], 0), ([(1, 2), (2, 3)], 0)])
def test_ring(edges, n):
    ring = G.ring_of(edges)
    assert len(ring) == n and (not ring or ring[0] == ring[-1])
    assert {frozenset(e) for e in zip(ring, ring[1:])} == ({frozenset(e) for e in edges} if n else set())


def test_covariances_stay_sound():
    from spotweave.operators.segmentation import Settings, shaped

    rng = np.random.default_rng(3)
    s = Settings(0.1, 0.025, 10)
    pts = [rng.uniform(size=(rng.integers(1, 100), 2)) * (rng.random() > 0.2) for _ in range(2000)]
    cov = np.array([np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((2, 2)) for p in pts])
    out = shaped(cov, np.array([len(p) for p in pts]), s)
    assert np.isfinite(out).all() and (np.linalg.det(out) > 1e-10).all()
    assert (out[cov[:, 0, 1] < 0][:, 0, 1] == 0).all()
