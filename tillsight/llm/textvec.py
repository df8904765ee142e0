"""Vectorised text primitives on the concatenated bytes of many documents:
word spans, 64-bit hashes of spans, and per-document reductions."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_R = 0x9E3779B97F4A7C13  # odd, 3 mod 8
_RINV = pow(_R, -1, 1 << 64)
_CODE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: What a span's length adds to its hash.
LENGTH_CODE = U64(0x9FB21C651E98DF25)
_POW = {"n": 0, "up": None, "down": None}

#: ASCII white space: space and U+0009 to U+000D. No UTF-8 sequence of another
#: character holds these bytes, so words can be cut on bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i mod 2^64 for i < n."""
    if _POW["n"] < n:
        size = max(n, 1 << 16)
        for key, r in (("up", _R), ("down", _RINV)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done:done + step] = p[:step] * U64(pow(r, done, 1 << 64))
                done += step
            _POW[key] = p
        _POW["n"] = size
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The value that ``mix`` turns into ``h``."""
    h = h ^ (h >> U64(32))
    h *= U64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h ^= (h >> U64(29)) ^ (h >> U64(58))
    h *= U64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    h ^= h >> U64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` cuts spans out of it."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, whatever its place."""
    _, down = _powers(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) * LENGTH_CODE))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every document, and the words before
    each document (len(off) entries). A word never crosses documents."""
    n = len(data)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def per_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise flag over each document."""
    c = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Ordered hash of each run of ``size`` word hashes (len(h) - size + 1)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[k:k + n]
    return mix(out)


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """Document number of each item, given the items before each document."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
