"""Content-defined anchors: equal strings of a given length get equal anchors, wherever they stand."""

from __future__ import annotations

import numpy as np

#: An odd multiplier of a polynomial hash modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << n.bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    h = (total[k:] - total[:-k]) * _power(_INVERSE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def owned_windows(data: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the windows of `length` bytes that start at first..last have their anchor there.

    A window's anchor is the k-gram in it whose hash (upper half) is least, the last one on a tie. It depends on the
    window's bytes alone. first and last together cover every window once, in order.
    """
    h = gram_hashes(data, k)
    w = length - k + 1
    if len(h) < w:
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none
    place = np.arange(len(h), dtype=np.uint64)
    low = h >> np.uint64(32) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - place)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(h) - w + 1], low[w - span :])
    own = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return h[own[first]], own[first], first, np.append(first[1:] - 1, len(own) - 1)
