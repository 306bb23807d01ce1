"""Exact nearest neighbours as a spatial join.

Points are dealt into tiles of about equal size (quantiles of x, then of y in each strip), and each tile gets a margin
of its neighbours' points, a few spacings wide.  A tile answers its own queries; an answer is certain if it lies
nearer than the margin's end.  The few other queries visit all tiles that their k-th distance so far reaches, and the
candidates are merged.  One shuffle of points, no pair of tiles is compared that cannot matter, no group grows with the
data.  In more than three dimensions, where tiles don't help, blocks of queries meet all blocks of points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import near as local
from ..functions.shared import cut

#: A tile has four times as many points; up to as many as a tile are held by every task.
TILE = 1000
#: Tiles whose borders the driver holds at most; beyond, tiles grow.
MAX_TILES = 1_000_000
#: Points and queries of a block, in more than three dimensions.
BLOCK = 8192


def _nearest(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest points of each query, ties by id."""
    order = np.argsort(pid, kind="stable")
    pid, p = pid[order], p[order]
    k = min(k, len(pid))
    idx, sq = local.nearest(q, p, k) if q.shape[1] <= 3 else local.nearest_of_all(q, p, k)
    return pd.DataFrame({"src": np.repeat(qid, k).astype("int64"), "dst": pid[idx].ravel().astype("int64"), "dist": np.sqrt(sq).ravel()})


@dataclass
class Grid:
    """Tiles of the plane: borders of the strips, and of the tiles in each strip; their corners, which the data's bounds close
    (bounds) or nothing does (lo, hi); and the width of each tile's margin."""

    dims: list[str]
    xs: np.ndarray
    ys: list[np.ndarray]
    begins: np.ndarray
    bounds: tuple
    lo: np.ndarray
    hi: np.ndarray
    margin: np.ndarray

    def home(self, q: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.xs, q[:, 0], "right")
        t = self.begins[s].copy()
        if q.shape[1] > 1:
            for i in np.unique(s):
                t[s == i] += np.searchsorted(self.ys[i], q[s == i, 1], "right")
        return t

    def known(self, tile: int, q: np.ndarray) -> np.ndarray:
        """How far from each query all points are in the tile or its margin."""
        m, q = self.margin[tile], q[:, : self.lo.shape[1]]
        return np.minimum(q - (self.lo[tile] - m), self.hi[tile] + m - q).min(1)

    def place(self, df: DataFrame, margins: bool) -> DataFrame:
        """df (id and coordinates) with the tile of each row and whether it is the row's own; with margins, rows also stand in
        the tiles in whose margin they lie."""
        dims = self.dims

        def placed(batches):
            for b in batches:
                q = b[dims].to_numpy().reshape(-1, len(dims))
                home = self.home(q)
                yield b.assign(tile=home, own=True)
                if margins:
                    for s in range(len(self.xs) + 1):
                        first, m = self.begins[s], self.margin[self.begins[s]]
                        r = np.flatnonzero((q[:, 0] >= self.lo[first, 0] - m) & (q[:, 0] <= self.hi[first, 0] + m))
                        if not len(r):
                            continue
                        a = z = np.zeros(len(r), np.int64)
                        if len(dims) > 1:
                            a, z = np.searchsorted(self.ys[s], q[r, 1] - m, "left"), np.searchsorted(self.ys[s], q[r, 1] + m, "right")
                        n = z - a + 1
                        r, t = np.repeat(r, n), first + np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        yield b.iloc[r[t != home[r]]].assign(tile=t[t != home[r]], own=False)

        return df.select("id", *dims).mapInPandas(placed, "id long, " + ", ".join(f"{d} double" for d in dims) + ", tile long, own boolean")


def grid_of(points: DataFrame, dims: list[str], n: int, size: int, reach: float) -> Grid:
    """Tiles of about so many points, with margins of so many mean spacings of their strip."""
    want = min(MAX_TILES, max(1, -(-n // size)))
    strips = max(1, round(math.sqrt(want))) if len(dims) > 1 else want
    along = max(1, round(want / strips))
    shares = lambda k: [i / k for i in range(1, k)]
    x = points.agg(F.min(dims[0]), F.max(dims[0]), *([F.percentile_approx(dims[0], shares(strips), 10_000)] if strips > 1 else [])).first()
    xs = np.array(sorted(set(x[2]))) if strips > 1 else np.zeros(0)
    edges = [x[0], *xs, x[1]]
    if len(dims) == 1:
        ys, spans, counts = [np.zeros(0)] * (len(xs) + 1), None, [n / (len(xs) + 1)] * (len(xs) + 1)
    else:
        def strip(batches):
            for b in batches:
                yield pd.DataFrame({"s": np.searchsorted(xs, b[dims[0]].to_numpy(), "right"), "y": b[dims[1]]})

        found = points.select(*dims[:2]).mapInPandas(strip, "s long, y double").groupBy("s").agg(F.min("y"), F.max("y"), F.count("*"), F.percentile_approx("y", shares(along) or [0.5], 10_000)).collect()  # one row for each strip
        ys, spans, counts = [np.zeros(0)] * (len(xs) + 1), [(0.0, 0.0)] * (len(xs) + 1), [1] * (len(xs) + 1)
        for s, y0, y1, c, b in found:
            ys[s], spans[s], counts[s] = np.array(sorted(set(b))) if along > 1 else np.zeros(0), (y0, y1), c
    begins = np.cumsum([0] + [len(y) + 1 for y in ys])
    lo, hi, margin = np.full((begins[-1], min(2, len(dims))), -np.inf), np.full((begins[-1], min(2, len(dims))), np.inf), np.zeros(begins[-1])
    for s in range(len(xs) + 1):
        own = slice(begins[s], begins[s + 1])
        lo[own, 0], hi[own, 0] = xs[s - 1] if s else -np.inf, xs[s] if s < len(xs) else np.inf
        width = edges[s + 1] - edges[s]
        if spans:
            lo[own, 1], hi[own, 1] = [-np.inf, *ys[s]], [*ys[s], np.inf]
            height = spans[s][1] - spans[s][0]
            margin[own] = reach * (math.sqrt(width * height / counts[s]) or max(width, height) / counts[s])
        else:
            margin[own] = reach**2 * width / counts[s]
    least, most = ([x[0], min(y[0] for y in spans)], [x[1], max(y[1] for y in spans)]) if spans else ([x[0]], [x[1]])
    return Grid(dims, xs, ys, begins, (np.maximum(lo, least), np.minimum(hi, most)), lo, hi, margin)


def _reached(q: np.ndarray, far: np.ndarray, xs: np.ndarray, ys: list[np.ndarray], begins: np.ndarray):
    """Pairs of a query and a tile that its reach may touch, a million or so at a time: strips by x, then tiles by y."""
    lo, hi = np.searchsorted(xs, q[:, 0] - far, "left"), np.searchsorted(xs, q[:, 0] + far, "right")
    for s in range(int(lo.min(initial=len(xs) + 1)), int(hi.max(initial=-1)) + 1):
        r = np.flatnonzero((lo <= s) & (s <= hi))
        if q.shape[1] > 1:
            a, z = np.searchsorted(ys[s], q[r, 1] - far[r], "left"), np.searchsorted(ys[s], q[r, 1] + far[r], "right")
        else:
            a = z = np.zeros(len(r), np.int64)
        n = z - a + 1
        upto, at = np.cumsum(n), 0
        while at < len(r):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000, "right")))
            k = n[at:end]
            j = np.repeat(a[at:end] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            yield np.repeat(r[at:end], k), begins[s] + j
            at = end


def knn(points: DataFrame, k: int, queries: DataFrame | None = None, dims: tuple = ("x", "y"), key: str = "molecule_id") -> DataFrame:
    """src, dst, dist, rank (1-based) of the k nearest points of each query; a point is its own first
    neighbour if the queries are the points.  Ties go to the lesser id."""
    dims = list(dims)
    own = queries is None
    pts = points.select(F.col(key).cast("long").alias("id"), *(F.col(d).cast("double") for d in dims))
    qs = pts if own else queries.select(F.col(key).cast("long").alias("id"), *(F.col(d).cast("double") for d in dims))
    n = pts.count()
    if n <= 4 * TILE:  # few points, a proven bound: every query's task holds them all
        few = pts.toPandas()
        pid, p = few["id"].to_numpy(), few[dims].to_numpy().reshape(-1, len(dims))

        def direct(batches):
            for b in batches:
                yield _nearest(b["id"].to_numpy(), b[dims].to_numpy().reshape(-1, len(dims)), pid, p, k)

        found = qs.repartition(max(1, int(qs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(direct, "src long, dst long, dist double")
        return _ranked(found, k)
    if len(dims) > 3:
        return _ranked(_by_blocks(pts, n, qs, n if own else qs.count(), dims, k), k)
    grid = grid_of(pts, dims, n, 4 * TILE, 1.5 * math.sqrt(k) + 1)
    coordinates = lambda df: df[dims].to_numpy().reshape(-1, len(dims))

    def answered(tile: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Certain answers; for other queries one row with the k-th distance so far."""
        q = coordinates(left)
        found = _nearest(left["id"].to_numpy(), q, right["id"].to_numpy(), coordinates(right), k)
        m = min(k, len(right))
        far = found["dist"].to_numpy().reshape(-1, m)[:, -1] if m == k else np.full(len(q), np.inf)
        sure = far < grid.known(tile, q)
        some = found[np.repeat(sure, m)].assign(rank=np.tile(np.arange(1, m + 1, dtype="int32"), int(sure.sum())), sure=True)
        other = pd.DataFrame({"src": left["id"].to_numpy()[~sure], "dst": -1, "dist": far[~sure], "rank": np.int32(0), "sure": False})
        return other if not len(some) else pd.concat([some, other]) if len(other) else some

    def alone(key, pdf):
        return answered(int(key[0]), pdf[pdf["own"]], pdf)

    def apart(key, left, right):
        return answered(int(key[0]), left, right)

    schema = "src long, dst long, dist double, rank int, sure boolean"
    wide = grid.place(pts, True)
    first = cut(wide.groupBy("tile").applyInPandas(alone, schema) if own else grid.place(qs, False).groupBy("tile").cogroup(wide.groupBy("tile")).applyInPandas(apart, schema), "neighbours")
    sure, bound = first.where("sure").select("src", "dst", "dist", "rank"), first.where("NOT sure").select(F.col("src").alias("id"), F.col("dist").alias("far"))
    if bound.isEmpty():
        return sure
    second = within_reach(grid, qs.join(bound, "id"), grid.place(pts, False), k)
    return sure.union(_ranked(second, k))


def within_reach(grid: Grid, asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """src, dst, dist: each query's k nearest points of every tile that its distance far reaches, and no farther ones.  asked:
    id, coordinates, far; placed: points in their own tiles, of which only those asked for are sent."""
    dims = grid.dims
    low, high = grid.bounds
    coordinates = lambda df: df[dims].to_numpy().reshape(-1, len(dims))

    def visits(batches):
        for b in batches:
            q, far = coordinates(b), b["far"].to_numpy()
            for r, t in _reached(q, far, grid.xs, grid.ys, grid.begins):
                gap = np.maximum(np.maximum(low[t] - q[r, : low.shape[1]], q[r, : low.shape[1]] - high[t]), 0)
                near = np.sqrt((gap**2).sum(1)) <= far[r]
                yield b.iloc[r[near]][["id", *dims, "far"]].assign(tile=t[near])

    def in_reach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(left["id"].to_numpy(), coordinates(left), right["id"].to_numpy(), coordinates(right), k)
        return found[found["dist"].to_numpy() <= np.repeat(left["far"].to_numpy(), min(k, len(right)))]

    visit = cut(asked.select("id", *dims, "far").mapInPandas(visits, f"id long, {', '.join(f'{d} double' for d in dims)}, far double, tile long"), "visits")
    met = placed.join(F.broadcast(visit.select("tile").distinct()), "tile", "left_semi")  # tiles: MAX_TILES at most
    return visit.groupBy("tile").cogroup(met.groupBy("tile")).applyInPandas(in_reach, "src long, dst long, dist double")


def _by_blocks(pts: DataFrame, n: int, qs: DataFrame, m: int, dims: list[str], k: int) -> DataFrame:
    """src, dst, dist: candidates of each query from each block of points.  Every pair is compared, a block of queries with one
    of points at a time; tasks hold two blocks, and each row is sent once for each block of the other side."""
    a, b = max(1, -(-m // BLOCK)), max(1, -(-n // BLOCK))
    vector = lambda df: df.select("id", F.array(*dims).alias("v"))
    left = vector(qs).select("*", F.pmod(F.xxhash64("id"), F.lit(a)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("pb"))
    right = vector(pts).select("*", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("qb"))

    def pair(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"src": np.zeros(0, "int64"), "dst": np.zeros(0, "int64"), "dist": np.zeros(0)})
        return _nearest(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), p["id"].to_numpy(), np.stack(p["v"].to_numpy()), k)

    return left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInPandas(pair, "src long, dst long, dist double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def interpolate(points: DataFrame, queries: DataFrame, values: list[str], k: int = 5, dims: tuple = ("x", "y"), key: str = "molecule_id", offset: float = 1e-10) -> DataFrame:
    """Inverse-distance means of the values of the k nearest points."""
    near = knn(points, k, queries, dims, key)
    w = 1 / (F.col("dist") + offset)
    some = near.join(points.select(F.col(key).alias("dst"), *values), "dst")
    return some.groupBy(F.col("src").alias(key)).agg(*((F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values))


def scale_from_assignment(molecules: DataFrame, least: int, cell: str = "cell", dims: tuple = ("x", "y")) -> DataFrame:
    """scale and scale_std: median and MAD of half the distance between neighbouring cells' centres."""
    from .raster import median_mad

    centres = molecules.where(F.col(cell) > 0).groupBy(F.col(cell).alias("molecule_id")).agg(*(F.avg(d).alias(d) for d in dims), F.count("*").alias("n")).where(F.col("n") >= least)
    if centres.count() < 3:
        raise ValueError("fewer than three cells have enough molecules")
    half = knn(centres, 2, None, dims).where(F.col("rank") == 2).select((F.col("dist") / 2).alias("r"))
    return median_mad(half, "r")
