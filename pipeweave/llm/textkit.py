"""Vectorised text primitives over Arrow string buffers.

A batch is walked in chunks of about a megabyte of whole documents, so working memory is bounded
by the chunk or by the longest document. Words are runs of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MIX = np.random.default_rng(20240602).integers(1, 1 << 62, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LENGTH = np.arange(64, dtype=U64) * _MIX[63]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for k, b in (("up", _BASE), ("down", _INV)):
            out = np.full(n, b, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive rows; bounds are relative to bytes. Null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 8192)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word byte spans, and for each row the index of its first word (with a final end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    solid = ~_WS[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial hash."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _MIX[0])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries; entry i covers i..i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, _LENGTH[k], U64)
    for j in range(k):
        out += h[j : j + n] * _MIX[j + 1]
    return mix(out)


def short_hash(h: np.ndarray) -> np.ndarray:
    """The hash of one whole sequence shorter than a window, as an array of one."""
    return mix((h * _MIX[1 : len(h) + 1]).sum(dtype=U64, keepdims=True) + _LENGTH[len(h)])


def window_rows(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie inside one row."""
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok
