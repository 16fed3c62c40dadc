"""Words of whole texts as numpy arrays: boundaries, 64-bit hashes and shingles, a slice of rows at a time.

Texts arrive as Arrow batches. ``slices`` cuts a batch into runs of rows of about ``SLICE_BYTES``, so the
arrays of a task stay small whatever the batch holds; a longer text is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of letters and digits: ASCII that is neither; other scripts stay in words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text is empty."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``SLICE_BYTES``."""
    if not len(column):
        return
    data, offsets = flat(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a slice: first and end byte of each, and the first word of each row (``row_start``, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.data = data
        self.start = np.flatnonzero(here & (~before | cut))
        self.end = np.flatnonzero(before & (~here | cut))
        self.row_start = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row_start))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, by differences of one running polynomial over the slice."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        powers = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers[1][self.start])


_table: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_table[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _table[k] = np.cumprod(steps)
    return _table


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``width`` words; a row with fewer words has one run of all its words, an empty row none."""
    hashes, counts = words.hashes(), np.diff(words.row_start)
    n_runs = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    row = np.repeat(np.arange(len(counts)), n_runs)
    first = np.repeat(words.row_start[:-1] - np.concatenate([[0], np.cumsum(n_runs)[:-1]]), n_runs) + np.arange(len(row))
    value, padded = np.zeros(len(row), np.uint64), np.concatenate([hashes, np.zeros(width, np.uint64)])
    short = np.minimum(counts, width)[row]
    for k in range(width):
        part = np.where(short > k, padded[first + k], np.uint64(0)) if len(row) else value
        value = (value + part) * _BASE
    return mix(value), row
