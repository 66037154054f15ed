"""A minimal perfect hash over 64-bit keys as numpy arrays.

Level by level: each key claims the cell that the level's hash gives it; keys alone in
their cell are placed, the others go on to the next, smaller level. A key's index is the
number of placed cells before its own, so n keys get 0 .. n - 1.
"""

from __future__ import annotations

import numpy as np

from .words import mix

GAMMA = 2.0


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes and packed bits of the levels. keys: distinct uint64."""
    sizes, bits = [], []
    while len(keys):
        size = max(8, -(-int(GAMMA * len(keys)) // 8) * 8)
        cells = _cells(keys, len(sizes), size)
        alone = np.bincount(cells, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone))
        keys = keys[~alone[cells]]
    return sizes, b"".join(b.tobytes() for b in bits)


def index(sizes: list[int], packed: bytes, keys: np.ndarray) -> np.ndarray:
    """The index of each key; -1, or any index at all, for keys that the hash was not built from."""
    bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
    rank = np.cumsum(bits) - 1
    out = np.full(len(keys), -1, dtype=np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        cells = base + _cells(keys[todo], level, size)
        hit = bits[cells]
        out[todo[hit]] = rank[cells[hit]]
        todo, base = todo[~hit], base + size
    return out
