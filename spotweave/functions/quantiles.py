"""Exact quantiles of a whole column without one buffer of all its values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many values are sorted on the driver at most.
FEW = 100_000


def _ranked(values: DataFrame, n: int, ranks: list[int]) -> dict[int, float]:
    """The values of some 0-based ranks: brackets from a sketch, counted exactly, and narrowed until few values are left."""
    if n <= FEW:
        found = sorted(r[0] for r in values.collect())
        return {k: found[k] for k in ranks}
    wide = 1e-3
    shares = [min(1.0, max(0.0, k / (n - 1) + s)) for k in ranks for s in (-wide, wide)]
    bounds = values.agg(F.percentile_approx("v", shares, 10_000)).first()[0]
    pairs = {k: (bounds[2 * i], bounds[2 * i + 1]) for i, k in enumerate(ranks)}
    v = F.col("v")
    counts = values.agg(*(F.count(F.when(c, 1)) for lo, hi in pairs.values() for c in (v < lo, v <= lo, v < hi))).first()
    out = {}
    for i, (k, (lo, hi)) in enumerate(pairs.items()):
        below, upto, before = counts[3 * i : 3 * i + 3]
        if below <= k < upto:
            out[k] = lo
        elif k >= before:
            out[k] = hi
        else:
            out[k] = _ranked(values.where((v > lo) & (v < hi)), before - upto, [k - upto])[k - upto]
    return out


def quantiles(df: DataFrame, value: Column | str, shares: list[float]) -> list[float | None]:
    """The quantiles of a numeric column, linear between ranks, nulls left out; None where no value is."""
    values = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    found = _ranked(values, n, sorted({k for p in at for k in (math.floor(p), math.ceil(p))}))
    low = [(math.floor(p), math.ceil(p), p) for p in at]
    return [found[a] if a == b else (b - p) * found[a] + (p - a) * found[b] for a, b, p in low]
