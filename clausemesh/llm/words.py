"""Word hashes of whole Arrow string columns, computed over their bytes with numpy.

A word is a run of ASCII letters, digits and non-ASCII characters after lower-casing A-Z; every byte of a character
outside ASCII is at least 0x80, so words can be cut in the UTF-8 bytes. A word's hash is a polynomial modulo 2^64,
taken from one running sum over the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, BLOCK_BYTES * 2), base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Block:
    """Words of the rows first .. first + len(n_words) of a column; doc counts from first."""

    first: int
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    before: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    upper: np.ndarray

    def word(self, i: int) -> str:
        return self.low[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array) -> Iterator[Block]:
    """The column's words in blocks of rows of about BLOCK_BYTES; a longer row is a block of its own."""
    if not len(column):
        return
    offsets, data = strings(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        yield _block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def _block(first: int, raw: np.ndarray, offsets: np.ndarray) -> Block:
    low = _LOWER[raw]
    inside = _WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    return Block(first, low, starts, ends, doc, n_words, bounds[:-1], hashes, offsets[:-1], low != raw)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, whatever document they are in."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j : j + size]
    return mix(out)
