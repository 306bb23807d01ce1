"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
REMEMBERED = 100_000


class WordHashes:
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        out = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(out == -1)
        if len(missing):
            if len(known) > REMEMBERED:
                known.clear()
            for i in missing.tolist():
                w = words[i]
                h = known[w] = (xxhash.xxh64_intdigest(w) >> 1) | 1 << 61  # never -1
                out[i] = h
        return out.view(np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The polynomial hash of every run of k hashes, by doubling: about 2 log k operations."""
    if len(h) < k:
        return h[:0]
    cur, size, out, done = mix(h, seed) if seed else h, 1, None, 0
    while True:
        if k >> (size.bit_length() - 1) & 1:
            if out is None:
                out, done = cur, size
            else:
                n = len(h) - (done + size) + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + cur[done : done + n]
                done += size
        if done == k:
            return mix(out, k)
        cur = cur[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + cur[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    cur = x
    while size * 2 <= w:
        cur, size = np.minimum(cur[:-size], cur[size:]), size * 2
    return np.minimum(cur[: len(cur) - (w - size)], cur[w - size :]) if size < w else cur
