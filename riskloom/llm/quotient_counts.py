"""Counting quotient filters over packed pairs and triples of word ids, as numpy arrays.

A tuple of ids is packed into 2 x w bits and permuted by a Feistel network, which is a bijection: the
quotient (leading bits) picks the slot range, the remainder is stored in full, so counts are exact and
the tuple comes back by running the network backwards.  A filter is sorted by permuted value; filters of
several shards are merged by concatenating runs, sorting and adding equal values.
"""

from __future__ import annotations

import numpy as np

ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)  # any odd values
ONE = np.uint64(1)


def half_bits(n: int, id_bits: int) -> int:
    """Bits of either half of a packed tuple of n ids."""
    return (n * id_bits + 1) // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scrambled(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    mixed = (half + np.uint64(key >> 32)) * np.uint64(key)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed & _mask(bits)


def permuted(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for key in ROUNDS:
        high, low = low, high ^ _scrambled(low, key, bits)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(ROUNDS):
        high, low = low ^ _scrambled(high, key, bits), high
    return high, low


def packed(ids: list[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two or three arrays of ids as high and low halves."""
    ids = [a.astype(np.uint64) for a in ids]
    if len(ids) == 2:
        return ids[0], ids[1]
    first, middle, last = ids
    upper = half_bits(3, id_bits) - id_bits  # bits of the middle id that go to the high half
    lower = id_bits - upper
    high = (first << np.uint64(upper)) | (middle >> np.uint64(lower))
    return high, ((middle & _mask(lower)) << np.uint64(id_bits)) | last


def unpacked(high: np.ndarray, low: np.ndarray, n: int, id_bits: int) -> list[np.ndarray]:
    if n == 2:
        return [high, low]
    upper = half_bits(3, id_bits) - id_bits
    lower = id_bits - upper
    middle = ((high & _mask(upper)) << np.uint64(lower)) | (low >> np.uint64(id_bits))
    return [high >> np.uint64(upper), middle, low & _mask(id_bits)]


def merged(
    high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by permuted value, equal values added."""
    if not len(high):
        return high, low, counts
    if bits <= 32:
        value = (high << np.uint64(bits)) | low
        order = np.argsort(value, kind="stable")  # concatenated runs: cheap
        value = value[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
    else:
        order = np.lexsort((low, high))
        a, b = high[order], low[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    first = np.flatnonzero(new)
    kept = order[first]
    return high[kept], low[kept], np.add.reduceat(counts[order], first)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: the zero ones compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def to_bytes(high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A sorted filter; neighbours differ little, so differences of the values are kept."""
    if not len(high):
        return b""
    if bits <= 32:
        value = (high << np.uint64(bits)) | low
        parts = (np.diff(value, prepend=np.uint64(0)), counts.astype(np.uint64))
    else:
        parts = (np.diff(high, prepend=np.uint64(0)), low, counts.astype(np.uint64))
    return b"".join(_planes(p) for p in parts)


def from_bytes(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not data:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64)
    kinds = 2 if bits <= 32 else 3
    size = len(data) // kinds
    parts = [_from_planes(data[k * size : (k + 1) * size]) for k in range(kinds)]
    first, counts = np.cumsum(parts[0], dtype=np.uint64), parts[-1].astype(np.int64)
    if bits <= 32:
        return first >> np.uint64(bits), first & _mask(bits), counts
    return first, parts[1], counts
