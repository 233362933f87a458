"""Polynomial hashes over bytes, vectorised: any stretch of a text in constant time."""

from __future__ import annotations

import numpy as np

from .common import by_value

by_value(__name__)

BASE = 0x9E3779B97F4A7C15
#: A random odd number for each byte value, the same in every process.
TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


class Powers:
    """Powers of the base and of its inverse, made where they are used and kept for longer texts."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            size = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * power(BASE, size)])
            cls.down = np.concatenate([cls.down, cls.down * power(pow(BASE, -1, 1 << 64), size)])
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def running(values: np.ndarray) -> np.ndarray:
    """Sums from the start; the hash of [a, b) is (sums[b] - sums[a]) * down[a]."""
    up, _ = Powers.get(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
