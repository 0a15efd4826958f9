"""Polynomial hashes of byte ranges from prefix sums, modulo 2 to the 64."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to size."""
    up, down = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
    for out, base in ((up, BASE), (down, BASE_INVERSE)):
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return up, down


def prefix_sums(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """sums[b] - sums[a], times the inverse power of a, is the hash of data[a:b]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
