"""Numpy work on columns of text as they arrive in Arrow batches.

A string column is one buffer of UTF-8 bytes and the places where each row starts. Words, lines and
their hashes come from whole-array operations over a bounded part of that buffer at a time, so no
Python string is made for a word. A row is never split: the part holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a part by itself.
PART_BYTES = 1 << 17

#: Bytes that end a word: blank and \\x09-\\x0D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words made of digits, letters and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@dataclass
class Part:
    """Some rows of a batch: their bytes, and where each row starts and ends in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[Part]:
    """The rows of a string column in order, in parts of bounded size; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    where = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(where, where[first] + most, side="right")) - 1)
        last = min(last, n)
        yield Part(first, data[where[first] : where[last]], where[first : last + 1] - where[first])
        first = last


def strings(column: pa.Array) -> list[str | None]:
    """The rows as Python strings; bytes that are not UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        octets = column.cast(pa.large_binary()).to_pylist()
        return [x if x is None else x.decode("utf-8", "replace") for x in octets]


@dataclass
class Spans:
    """Runs of wanted bytes: where they start and end, the row of each, and each row's first run."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def index(self) -> np.ndarray:
        """Each run's place in its row."""
        return np.arange(len(self.starts)) - self.first[self.row]


def spans(part: Part, wanted: np.ndarray) -> Spans:
    """The maximal runs of wanted bytes; the end of a row ends a run."""
    n = len(part.data)
    keep = wanted[part.data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:]
    edges = part.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = keep[edges]
    ends[edges - 1] = keep[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, part.offsets)
    return Spans(starts, stops, np.repeat(np.arange(len(part)), np.diff(first)), first)


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that can be undone, so it adds no collisions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit hashes of byte runs: equal bytes, equal hash, wherever they stand."""

    def __init__(self) -> None:
        self._up = np.ones(1, dtype=np.uint64)
        self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, PART_BYTES)
            self._up = np.full(n, _MULTIPLIER, dtype=np.uint64)
            self._down = np.full(n, _INVERSE, dtype=np.uint64)
            self._up[0] = self._down[0] = 1
            np.cumprod(self._up, out=self._up)
            np.cumprod(self._down, out=self._down)
        return self._up, self._down

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def sequence_hash(items: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's whole sequence of hashes."""
    n = len(items)
    sums = np.zeros(n + 1, dtype=np.uint64)
    power = np.full(n, (seed * 2 + 1) & ((1 << 64) - 1), dtype=np.uint64)
    back = pow((seed * 2 + 1) & ((1 << 64) - 1), -1, 1 << 64)
    down = np.full(n + 1, back, dtype=np.uint64)
    if n:
        power[0] = 1
        np.cumprod(power, out=power)
    down[0] = 1
    np.cumprod(down, out=down)
    np.cumsum(mix(items ^ np.uint64(seed)) * power, out=sums[1:])
    whole = (sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]]
    return mix(whole + np.diff(first).astype(np.uint64) * np.uint64(_MULTIPLIER))


def shingles(words: np.ndarray, found: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and each row's first one.

    A row with fewer than ``n`` words, but not none, has its whole sequence as the only one.
    """
    counts = found.counts
    many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(many, out=first[1:])
    row = np.repeat(np.arange(len(counts)), many)
    at = found.first[row] + (np.arange(first[-1]) - first[row])
    size = np.minimum(counts[row], n)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        there = np.minimum(at + k, max(len(words) - 1, 0))
        part = mix(words[there] + np.uint64(((k + 1) * _MULTIPLIER) & ((1 << 64) - 1)))
        out += np.where(k < size, part, np.uint64(0)) if n > 1 else part
    return mix(out + size.astype(np.uint64)), first


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from all values and each row's first one."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def byte_strings(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow column of bytes from all bytes and each row's first one."""
    offsets = pa.py_buffer(first.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, offsets, pa.py_buffer(values)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
