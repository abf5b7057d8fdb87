"""Words of whole Arrow string columns, found and hashed with numpy.

A column is handled as one byte buffer with row offsets, so the cost per byte
is a few vector operations and memory follows the slice being worked on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer single row is a slice of its own.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = last


@dataclass
class Words:
    """Words of some rows: lower-cased bytes, word bounds, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hashes, eight bytes of each word at a step."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        left = self.ends - self.starts
        out = left.astype(np.uint64) * _M2
        at, live = self.starts, None
        with np.errstate(over="ignore"):
            while True:
                part = eight[at] & _KEEP[np.minimum(left, 8)]
                h = (out if live is None else out[live]) ^ part
                h *= _M1
                h ^= h >> np.uint64(29)
                h *= _M2
                h ^= h >> np.uint64(32)
                if live is None:
                    out = h
                else:
                    out[live] = h
                more = np.flatnonzero(left > 8)
                if not len(more):
                    return out
                live = more if live is None else live[more]
                at, left = at[more] + 8, left[more] - 8


    def prefix_hashes(self, size: int) -> np.ndarray:
        """64-bit hashes of the first ``size`` bytes (8 at most) of each longer word; zero for others."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = (eight[self.starts] & _KEEP[size]) ^ (np.uint64(size) * _M2)
            h *= _M1
            h ^= h >> np.uint64(29)
            h *= _M2
            h ^= h >> np.uint64(32)
        h[self.ends - self.starts <= size] = 0
        return h


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of rows; ``offsets`` may begin anywhere in ``data``. A-Z count as a-z."""
    low = _LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    inside = kind[low]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    first, last = at[:-1][full], at[1:][full] - 1
    begin[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(begin)
    return Words(low, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and each row's first shingle.

    A row with fewer words, but not none, has one shingle of them all.
    """
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    firsts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = rows[:-1][row] + np.arange(firsts[-1]) - firsts[:-1][row]
    width = np.minimum(size, n)[row]
    out = width.astype(np.uint64)
    top = max(len(words) - 1, 0)
    with np.errstate(over="ignore"):
        for k in range(size):
            step = (out ^ words[np.minimum(at + k, top)]) * _M1 if len(words) else out
            step ^= step >> np.uint64(31)
            step *= _M2
            out = step if (width > k).all() else np.where(width > k, step, out)
    return out, firsts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    doc = words_of(data, offsets, NOT_SPACE)
    shingles, firsts = shingle_hashes(doc.hashes(), doc.rows, size)
    return [np.unique(shingles[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
