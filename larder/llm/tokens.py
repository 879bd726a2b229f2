"""Words of texts as 64-bit hashes, found and hashed for many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C55  # odd, so its powers have inverses modulo 2^64
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 20)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)


def hash_words(mapped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs of non-zero bytes."""
    inside = np.concatenate([[False], mapped != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    _grow(len(mapped) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mapped * _powers[: len(mapped)], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * _inverses[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
