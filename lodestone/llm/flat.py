"""Whole texts as flat byte arrays, and hashes of words and word windows on them.

Arrow string columns are read without making Python strings: a slice of rows is one
`uint8` array with row offsets. Words are runs of bytes other than ASCII white space
(0x20, 0x09-0x0D). Hashes are polynomials modulo 2**64 over prefix sums, so the hash
of every window costs a subtraction and a multiplication, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18
WORD_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size."""
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, SLICE_BYTES + 1)
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            values = np.full(size, factor, dtype=np.uint64)
            values[0] = 1
            both.append(np.cumprod(values, dtype=np.uint64))
        known = both[0], both[1]
        if size <= 2 * SLICE_BYTES:
            _powers[base] = known
    return known


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a zero in front."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of [start, end) from prefix sums: equal content, equal hash, wherever it stands."""
    return (sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts and the row offsets in it; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for row ranges of about *limit* bytes."""
    data, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of a slice: byte ranges, rows, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        solid = ~separators[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & ~(before & ~edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & ~(after & ~edge[1:])) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.rows, minlength=len(offsets) - 1)
        #: First word of each row.
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.data = data

    def hashes(self) -> np.ndarray:
        sums = prefix(BYTE_VALUES[self.data], WORD_BASE)
        return mix(ranges(sums, self.starts, self.ends, WORD_BASE) + (self.ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of *size* words inside one row."""
        if len(hashes) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        sums = prefix(hashes, WINDOW_BASE)
        starts = np.flatnonzero(self.rows[: len(hashes) - size + 1] == self.rows[size - 1 :])
        return starts, mix(ranges(sums, starts, starts + size, WINDOW_BASE) + np.uint64(size))
