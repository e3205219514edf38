"""Rolling hashes over bytes and words, whole batches at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and inverse powers, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, m, np.uint64)))) for m in (MULTIPLIER, inverse))
    return up, down


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def size_class(n: int) -> int:
    """A power of two of at least n, so that few tables of powers are made."""
    return 1 << max(16, int(n).bit_length())


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers, one longer than values: range_hash() of any range comes from two of them."""
    up, _ = powers(size_class(len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range's values that doesn't depend on where it stands."""
    _, down = powers(size_class(len(prefix) - 1))
    return mix((prefix[end] - prefix[start]) * down[start])


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """range_hash() of every range of a width."""
    _, down = powers(size_class(len(prefix) - 1))
    n = max(0, len(prefix) - width)
    return mix((prefix[width:] - prefix[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours; as many values fewer by width - 1."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
