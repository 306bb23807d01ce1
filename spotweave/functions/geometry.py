"""Plane geometry of small point sets, in numpy and plain Python."""

from __future__ import annotations

import math

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The hull, counter-clockwise from the least point, closed; fewer than three points come back as they are."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts
    rows = pts.tolist()

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(rows), chain(rows[::-1])
    return np.array([*lower[:-1], *upper])


def ring_area(ring: np.ndarray) -> float:
    r = np.asarray(ring, float)
    if len(r) < 3:
        return 0.0
    x, y = r[:, 0], r[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indices) by incremental insertion: those whose circumcircle holds the new point are
    replaced by a fan over the hole's border.  The hole is found by a walk from the last triangle and grown over
    neighbours; points come in strips, to and fro, so walks stay short.  Repeated points take part once."""
    pts = np.asarray(points, float).reshape(-1, 2)
    _, first = np.unique(pts, axis=0, return_index=True)
    if len(first) < 3:
        return np.zeros((0, 3), int)
    low, span = pts.min(0), max(float(np.ptp(pts, axis=0).max()), 1e-12)
    unit = (pts - low) / span
    n = len(pts)
    # far outside: a hull edge's empty circle must not reach these
    px, py = [*unit[:, 0].tolist(), -1e4, 1e4, 0.5], [*unit[:, 1].tolist(), -1e4, -1e4, 2e4]

    def holds(t, x, y):
        """Whether a triangle's circle holds a point, by differences from it: as right for points nearly on one place."""
        a, b, c = tri[t]
        ax, ay, bx, by, cx, cy = px[a] - x, py[a] - y, px[b] - x, py[b] - y, px[c] - x, py[c] - y
        return (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx) > 0

    def around(hole):
        found = [(tri[t][j], tri[t][(j + 1) % 3], near[t][j], t) for t in hole for j in range(3) if near[t][j] not in hole]
        return found, len({e[0] for e in found}) == len({e[1] for e in found}) == len(found)

    # a triangle's corners counter-clockwise; near[t][i] lies across the edge from its corner i to the next one
    tri, near = [(n, n + 1, n + 2)], [[-1, -1, -1]]
    free: list[int] = []
    at = 0
    strips = max(1, math.isqrt(len(first) // 2))
    by_x = first[np.argsort(unit[first, 0], kind="stable")]
    order = [i for k, s in enumerate(np.array_split(by_x, strips)) for i in s[np.argsort(unit[s, 1] * (-1) ** k, kind="stable")].tolist()]
    for i in order:
        x, y = px[i], py[i]
        for _ in range(len(tri)):  # walk towards the point
            a, b, c = tri[at]
            for j, (u, v) in enumerate(((a, b), (b, c), (c, a))):
                if (px[v] - px[u]) * (y - py[u]) - (py[v] - py[u]) * (x - px[u]) < 0 and near[at][j] >= 0:
                    at = near[at][j]
                    break
            else:
                break
        hole, todo = {at}, [at]
        while todo:
            for o in near[todo.pop()]:
                if o >= 0 and o not in hole and holds(o, x, y):
                    hole.add(o)
                    todo.append(o)
        border, simple = around(hole)
        if not simple:  # rounding: the triangle that holds the point makes room alone
            hole = {at}
            border, _ = around(hole)
        free.extend(hole)
        begins: dict = {}
        made = []
        for u, v, o, _ in border:
            k = free.pop() if free else len(tri)
            if k == len(tri):
                tri.append((0, 0, 0))
                near.append([-1, -1, -1])
            begins[u] = k
            made.append((k, u, v, o))
        for k, u, v, o in made:
            tri[k] = (u, v, i)
            near[k] = [o, begins.get(v, -1), -1]
            if o >= 0:
                for j in range(3):
                    if tri[o][j] == v and tri[o][(j + 1) % 3] == u:
                        near[o][j] = k
        for k, u, v, o in made:
            if near[k][1] >= 0:
                near[near[k][1]][2] = k
        at = made[-1][0]
    gone = set(free)
    out = np.array([t for k, t in enumerate(tri) if k not in gone and max(t) < n], int).reshape(-1, 3)
    return np.sort(out, axis=1)


def voronoi_neighbours(centre: tuple, others: list[tuple], frame: tuple) -> tuple[list[int], float]:
    """Which of others (ascending by distance) share a border of the centre's Voronoi cell inside the
    frame (x0, y0, x1, y1), and the distance within which every point had to be known for that."""
    poly, reach = voronoi_cell(centre, others, frame)
    return sorted({o for *_, o in poly if o >= 0}), 2 * reach**0.5


def voronoi_cell(centre: tuple, others: list[tuple], frame: tuple) -> tuple[list[tuple], float]:
    """The cell's corners, each with the owner of the edge behind it (-1: the frame), and the largest
    squared distance of a corner from the centre."""
    x0, y0, x1, y1 = frame
    cx, cy = centre
    poly = [(x0, y0, -1), (x1, y0, -1), (x1, y1, -1), (x0, y1, -1)]  # vertex, and who owns the edge behind it
    reach = max((x - cx) ** 2 + (y - cy) ** 2 for x, y, _ in poly)
    for i, (px, py) in enumerate(others):
        dx, dy = px - cx, py - cy
        d2 = dx * dx + dy * dy
        if d2 == 0:
            continue
        if d2 > 4 * reach:
            break
        half = d2 / 2
        side = [(x - cx) * dx + (y - cy) * dy - half for x, y, _ in poly]
        if max(side) <= 0:
            continue
        out = []
        for k in range(len(poly)):
            x, y, owner = poly[k]
            s, t = side[k], side[(k + 1) % len(poly)]
            nx, ny, _ = poly[(k + 1) % len(poly)]
            if s <= 0:
                out.append((x, y, owner))
            if (s < 0 < t) or (t < 0 < s):
                f = s / (s - t)
                out.append((x + f * (nx - x), y + f * (ny - y), i if s < 0 else owner))
            elif s == 0 and t > 0:
                out[-1] = (x, y, i)
        poly = out
        if not poly:
            break
        reach = max((x - cx) ** 2 + (y - cy) ** 2 for x, y, _ in poly)
    return poly, reach


def points_in_triangle(p: np.ndarray, a, b, c) -> np.ndarray:
    """u >= 0, v >= 0, u + v < 1 in barycentric coordinates."""
    v0, v1, v2 = np.subtract(c, a), np.subtract(b, a), np.asarray(p, float) - a
    d00, d01, d11, d02, d12 = v0 @ v0, v0 @ v1, v1 @ v1, v2 @ v0, v2 @ v1
    det = d00 * d11 - d01 * d01
    if det == 0:
        return np.zeros(len(p), bool)
    u, v = (d11 * d02 - d01 * d12) / det, (d00 * d12 - d01 * d02) / det
    return (u >= 0) & (v >= 0) & (u + v < 1)


def border_edges(tri: list[tuple]) -> dict:
    """edge -> triangles that have it."""
    out: dict = {}
    for t, (a, b, c) in enumerate(tri):
        for e in ((a, b), (b, c), (a, c)):
            out.setdefault((min(e), max(e)), []).append(t)
    return out


def peel(points: np.ndarray, tri: np.ndarray, foreign: np.ndarray, passes: int = 100) -> list[tuple]:
    """Border edges after border triangles with foreign points have been taken away, pass by pass.  A triangle
    must have exactly one border edge, and its far corner may not lie on the border already (the
    ring would touch itself).  Only triangles at the border are asked for foreign points, those in their strip of x."""
    alive = [tuple(t) for t in tri.tolist()]
    foreign = foreign[np.argsort(foreign[:, 0], kind="stable")] if len(foreign) else np.zeros((0, 2))
    known: dict = {}

    def holds(t):
        if t not in known:
            corners = points[list(t)]
            lo, hi = np.searchsorted(foreign[:, 0], corners[:, 0].min(), "left"), np.searchsorted(foreign[:, 0], corners[:, 0].max(), "right")
            known[t] = bool(hi > lo) and bool(points_in_triangle(foreign[lo:hi], *corners).any())
        return known[t]

    for _ in range(passes):
        edges = border_edges(alive)
        border = [e for e, t in edges.items() if len(t) == 1]
        on = {v for e in border for v in e}
        count: dict = {}
        for e in border:
            t = edges[e][0]
            count.setdefault(t, []).append(e)
        gone = set()
        for t, own in sorted(count.items()):
            far = set(alive[t]) - set(own[0])
            if len(own) == 1 and not far & on and holds(alive[t]):
                gone.add(t)
                on |= far
        if not gone:
            break
        alive = [t for k, t in enumerate(alive) if k not in gone]
    return [e for e, t in border_edges(alive).items() if len(t) == 1]


def ring_of(edges: list[tuple]) -> list[int]:
    """Vertices along a closed border, beginning at the first edge; at most two edges make none."""
    if len(edges) <= 2:
        return []
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    start, at = edges[0]
    out, before = [start], start
    while at != start and len(out) <= min(len(edges), 10_000):
        out.append(at)
        step = [v for v in near[at] if v != before] or [before]
        before, at = at, step[0]
    return [*out, start]
