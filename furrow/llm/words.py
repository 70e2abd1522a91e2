"""Words and word hashes of whole Arrow batches, computed with NumPy on the UTF-8 bytes.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; these are ASCII, so bytes and code points agree. The hash of a
word is a polynomial modulo 2**64 over its bytes, passed through a finaliser; sequences of words are hashed the same way over
the hashes of their words. Long inputs can be made to collide under such a polynomial, so words of more than ``LONG`` bytes take a
cryptographic digest instead. Hashes depend on nothing but the words, so they are equal in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # its arrays stay in a core's cache
KEPT_POWERS = 1 << 20
LONG = 255
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_ONE = np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand; beyond ``KEPT_POWERS`` they are not held."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        while len(up) < n:
            size = len(up)
            up = np.concatenate([up, up * np.uint64(pow(self.base, size, 1 << 64))])
            down = np.concatenate([down, down * np.uint64(pow(self.inverse, size, 1 << 64))])
            if len(up) <= KEPT_POWERS:
                self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some consecutive rows: ``raw`` bytes, per word its byte range, row (counted from ``first``) and hash."""

    raw: bytes
    first: int
    rows: int
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, one more entry at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive) joined by one space."""
        raw = self.raw
        return b" ".join(raw[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start index and hash of every run of n words inside one row."""
        count = len(self.row) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.row[:count] == self.row[n - 1:])
        return at, mix(self._run(at, n))

    def _run(self, at: np.ndarray, n: int) -> np.ndarray:
        up, down = _WORDS.upto(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:-1], out=total[1:])
        return (total[at + n] - total[at]) * down[at]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def strings(column) -> pa.Array:
    """One contiguous string array from a column of a record batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES, plain: bool = False) -> Iterator[Words]:
    """Words of the column in blocks of about ``limit`` bytes; a row is never cut, a longer one is a block of its own.

    ``lower`` turns A-Z into a-z before hashing, also in ``raw``; ``plain`` makes ASCII punctuation and controls spaces too.
    """
    data, offsets = _buffer(strings(column))
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield _words(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], first,
                     _PLAIN if plain else _LOWER if lower else None)
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, first: int, change: np.ndarray | None) -> Words:
    if change is not None:
        data = change[data]
    rows, size = len(offsets) - 1, len(data)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return Words(b"", first, rows, none, none, none, none.astype(np.uint64))
    space = np.ones(size + 1, dtype=bool)
    space[:size] = _SPACE[data]
    before = np.ones(size, dtype=bool)
    before[1:] = space[:size - 1]
    cuts = offsets[:-1][offsets[:-1] < size]
    before[cuts] = True
    start = np.flatnonzero(before & ~space[:size])
    after = space[1:].copy()
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(after & ~space[:size]) + 1
    up, down = _BYTES.upto(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _ONE) * up[:size], out=total[1:])
    value = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG).tolist():
        value[k] = int.from_bytes(blake2b(data[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data.tobytes(), first, rows, start, end, row, value)


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
