"""Vectorised byte-level text primitives shared by the operators.

Texts arrive as Arrow string columns; everything here works on the UTF-8 buffer
of a block of whole documents (numpy ``uint8`` plus offsets), so no per-token
Python object is made.  A null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no glibc: its allocator decides alone
        return lambda _: 0


_TRIM = _trimmer()


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, and would keep its peak."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES):
    """(batch slice, bytes, offsets) for every block of whole rows."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        for a, b in blocks(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        release()


def _tables(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("_POWERS", _BASE), ("_INVERSES", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums modulo 2**64; ``span_hashes`` reads any span from them."""
    _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their high and low bits are both usable."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * _INVERSES[starts])


def tokens(data: np.ndarray, offsets: np.ndarray, words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, row offsets into them) of the tokens of a block.

    ``words``: maximal runs of ASCII alphanumerics and non-ASCII bytes; otherwise
    maximal runs of non-blank bytes.  ASCII case is folded.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORD[data] if words else ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hashes(prefix_hashes(LOWER[data]), starts, ends), starts, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (first axis) over the row ranges; empty rows give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
