"""Super-k-mers: maximal runs of consecutive windows that share one minimiser occurrence.

A window of `window` symbols holds `window - k + 1` k-mers; its minimiser is the leftmost k-mer with
the smallest hash. Equal windows have equal minimisers at equal offsets, so all copies of a window
meet under the minimiser's hash, and two windows of one run are never equal. A run of n windows is
one string of n + window - 1 symbols, in place of n strings of `window` symbols.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POS_BITS = 20
_CHUNK = 1 << 16  # windows per step: the arrays stay in the processor's cache
_POS = np.uint64((1 << _POS_BITS) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    x, m = 1, (1 << 64) - 1
    for i in range(n):
        out[i] = x
        x = x * base & m
    return out


_SPAN = _CHUNK + 4096
_POW = _powers(_SPAN, int(_BASE))
_INV = _powers(_SPAN, pow(int(_BASE), -1, 1 << 64))


def kmer_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """One mixed 64-bit hash per k-mer, from differences of prefix sums (modulo 2^64)."""
    n = len(symbols)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(symbols * _POW[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _INV[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _BASE
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def super_kmers(
    symbols: np.ndarray, window: int, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run: first window, number of windows, minimiser's position, and its hash (uint64)."""
    total = len(symbols) - window + 1
    if total <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, np.empty(0, dtype=np.uint64)
    starts, counts, anchors, hashes = [], [], [], []
    for at in range(0, total, _CHUNK):
        part = symbols[at : min(at + _CHUNK, total) + window - 1]
        h = kmer_hashes(part, k)
        # the position in the low bits makes the leftmost of equal hashes the smallest
        low = sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), window - k + 1)
        change = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate(([0], change))
        starts.append(first + at)
        counts.append(np.diff(np.concatenate((first, [len(low)]))))
        anchor = (low[first] & _POS).astype(np.int64)
        anchors.append(anchor + at)
        hashes.append(h[anchor])
    return tuple(np.concatenate(x) for x in (starts, counts, anchors, hashes))
