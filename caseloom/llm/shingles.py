"""Hashes of runs of characters (or words) over whole batches, and set measures on them."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def runs(values: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of k values within a row, and their row offsets.

    Rows shorter than k have no run.
    """
    n = np.maximum(np.diff(off) - (k - 1), 0)
    new = np.zeros(len(off), np.int64)
    np.cumsum(n, out=new[1:])
    if new[-1] == 0:
        return np.zeros(0, np.uint64), new
    v = values.astype(np.uint64)
    size = len(v) - k + 1
    h = v[:size].copy()
    for j in range(1, k):
        h *= _P
        h += v[j : j + size]
    # Windows that reach into the next row are left out.
    edge = np.zeros(len(v) + 1, np.int32)
    ends = off[1:]
    low = np.maximum(ends - (k - 1), off[:-1])
    np.add.at(edge, low, 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge)[:size] == 0
    return mix(h[inside]), new


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    new = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(row[first], minlength=len(off) - 1), out=new[1:])
    return h[first], new


def minhash(h: np.ndarray, off: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """rows x count matrix of minima under ``count`` hash functions; rows without a run get 0."""
    rows = len(off) - 1
    out = np.zeros((rows, count), np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    starts = off[:-1][full]
    keys = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(seed * 2 + 1) + _P)
    buffer = np.empty_like(h)
    for j in range(count):
        np.bitwise_xor(h, keys[2 * j], out=buffer)
        np.multiply(buffer, keys[2 * j + 1] | np.uint64(1), out=buffer)
        np.right_shift(buffer, np.uint64(11), out=buffer)
        out[full, j] = np.minimum.reduceat(buffer, starts)
    return out


def simhash(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit similarity fingerprints; rows without a run get 0."""
    rows = len(off) - 1
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    starts, half = off[:-1][full], np.diff(off)[full]
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), starts, dtype=np.int64)
        out[full] |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
