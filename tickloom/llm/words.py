"""Words of a batch of texts as numpy arrays: where they stand and 64-bit hashes of them and of their windows.

Texts stay UTF-8 bytes; the word classes here are ASCII sets, which no byte of a longer
character belongs to, so whole columns are cut at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False

#: Bytes of words of letters and digits, once A-Z are lower-cased: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP, _STEP2 = (int(x) | 1 for x in _rng.integers(0, 2**64, 3, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (fixed values: its published constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of its inverse)."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), np.uint64(pow(base, -1, 2**64) if inverse else base), dtype=np.uint64)
        x[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(x)
    return have[:n]


def _sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range: sum of values[i] * base**(i - start), modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _power(base, len(values) + 1, True)[starts]


@dataclass
class Words:
    """starts, ends: bytes of each word in data; first[r] .. first[r + 1]: the words of row r; hashes: of each word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    _hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = mix(_sums(_BYTE[self.data], _BASE, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, length: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of words) at which a window of so many words of one row starts, and the windows' hashes."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        ends = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + length <= ends)
        return at, mix(_sums(self.hashes, _STEP2 if second else _STEP, at, at + length) ^ np.uint64(length))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null: empty) and where each text starts and the last ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(column: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, rows = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before_start = before.copy()
    before_start[rows] = False  # a word never goes on into the next text
    starts = np.flatnonzero(inside & ~before_start)
    after_end = ~inside
    after_end[rows] = True
    ends = np.flatnonzero(before & after_end)
    return Words(data, starts, ends, np.searchsorted(starts, rows))
