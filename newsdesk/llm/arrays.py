"""Numpy kernels over the UTF-8 buffers of Arrow string columns: words, rolling hashes and segments.

Tasks receive Arrow batches; texts are worked on a few MB at a time, straight from the batch's buffer, so
memory follows the slice and the longest document, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def give_back() -> None:
    """Return what a task has freed to the system: workers live on from stage to stage, and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it has its own way


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory given back when the task's rows are through."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return through


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each one; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `limit` bytes of text each (one document at least)."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, so that short strings already differ in many bits.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: The same with A-Z read as a-z.
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any byte ranges of a buffer, after one pass over it."""

    def __init__(self, values: np.ndarray):
        """values: a 64-bit value for each position."""
        up, self._down = _power_tables(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the window at every position where one fits."""
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def byte_class(members: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in members:
        table[first : last + 1] = True
    return table


#: Bytes of words parted by \x20 and \x09-\x0D.
SPACED_WORD = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words of ASCII letters (of either case), digits and everything beyond ASCII.
PLAIN_WORD = ~byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Words:
    """Spans of the words of each text in a buffer; no word crosses texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        inside = member[data]
        n = len(data)
        self.offsets = offsets
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: first word of each text, and the number of words at the end
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, data: np.ndarray, lower: bool = True) -> np.ndarray:
        return Rolling((LOWER_VALUES if lower else BYTE_VALUES)[data]).hashes(self.starts, self.ends)


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the segment of each element, from the segments' first elements (and the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chains(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of each `width` neighbours; the last `width - 1` have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out + np.uint64(k)) ^ hashes[k : n + k]
    return mix(out)


def segment_unique(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment and the new first elements."""
    owner = owners(first)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(first)))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
