"""External induced sorting of a shard's suffixes, with common-prefix values carried along.

Suffixes are larger (L) or smaller (S) than the one after them; an S suffix after an L
one is a left-most S (LMS).  Sorted LMS suffixes induce all L suffixes in one ascending
scan, those all S suffixes in one descending scan: a scanned suffix appends the one
before it to the queue of that one's first byte.  The queues, one for each byte and
first-in-first-out within it, are the priority queue of the scan.  They hold tuples
(position, common prefix with the tuple before it), work in blocks of numpy arrays, and
move to unnamed files in the task's scratch folder when they outgrow ``memory`` bytes.

The common prefix of two tuples that meet in a queue is one more than the least among
the scanned tuples between those that induced them; a running least for each byte and a
sparse table of each block give it.  Where L and S tuples of a byte meet, it is the
shorter of the two runs of that byte.

LMS suffixes themselves are sorted by the same scans over their unsorted list, named by
their LMS substrings, and, where names repeat, ordered by recursion on the string of
names (the same scans while there are fewer than 256 names, doubling of ranks beyond).
Order and common prefixes are exact up to ``depth`` bytes; suffixes that agree on that
many may stand in any order.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

from .textops import prefix_hashes, span_hashes

BLOCK = 1 << 16
MEMORY = 64 << 20
DEPTH = 64
_NONE = np.uint8(255)


class Scratch:
    """The memory that the queues of one sort share, and the spilling of the largest of them."""

    def __init__(self, memory: int):
        self.memory, self.held, self.queues, self.spilled = memory, 0, [], 0

    def queue(self) -> Queue:
        self.queues.append(Queue(self))
        return self.queues[-1]

    def relieve(self) -> None:
        while self.held > self.memory:
            largest = max(self.queues, key=lambda q: q.size)
            if not largest.size:
                return
            largest.spill()

    def close(self) -> None:
        for q in self.queues:
            q.close()


class Queue:
    """First-in-first-out blocks of (positions, common prefixes), the oldest part on disk when memory is short."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.blocks, self.size, self.file, self.stored = scratch, deque(), 0, None, deque()

    def __bool__(self) -> bool:
        return bool(self.blocks or self.stored)

    def push(self, positions: np.ndarray, common: np.ndarray) -> None:
        self.blocks.append((positions, common))
        self.size += 5 * len(positions)
        self.scratch.held += 5 * len(positions)
        if self.scratch.held > self.scratch.memory:
            self.scratch.relieve()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induced-")  # has no name: gone with the task
        self.file.seek(0, 2)
        for positions, common in self.blocks:
            self.stored.append((self.file.tell(), len(positions)))
            self.file.write(positions.tobytes())
            self.file.write(common.tobytes())
        self.scratch.spilled += self.size
        self.scratch.held -= self.size
        self.blocks.clear()
        self.size = 0

    def _stored_block(self, at: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at[0])
        return np.frombuffer(self.file.read(4 * at[1]), np.int32), np.frombuffer(self.file.read(at[1]), np.uint8)

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """The oldest tuples, about a block of them."""
        parts, n = [], 0
        while self and n < BLOCK:
            if self.stored:
                part = self._stored_block(self.stored.popleft())
            else:
                part = self.blocks.popleft()
                self.size -= 5 * len(part[0])
                self.scratch.held -= 5 * len(part[0])
            parts.append(part)
            n += len(part[0])
        return parts[0] if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))

    def last_to_first(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All blocks from the newest to the oldest, without taking them out."""
        yield from reversed(self.blocks)
        for at in reversed(self.stored):
            yield self._stored_block(at)

    def close(self) -> None:
        self.scratch.held -= self.size
        self.blocks.clear()
        self.stored.clear()
        self.size = 0
        if self.file is not None:
            self.file.close()
            self.file = None


class _Scan:
    """Appends the suffixes before scanned ones to the queues of their first bytes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: list[Queue], carry: bool):
        self.text, self.wanted, self.queues, self.carry = text, wanted, queues, carry
        self.least = np.zeros(256, np.uint8)

    def bucket(self) -> None:
        """Another first byte begins: its tuples share nothing with those before."""
        self.least[:] = 0

    def block(self, positions: np.ndarray, common: np.ndarray) -> None:
        for a in range(0, len(positions), BLOCK):
            self._block(positions[a : a + BLOCK], common[a : a + BLOCK])

    def _block(self, positions: np.ndarray, common: np.ndarray) -> None:
        before = positions - 1
        place = np.flatnonzero((positions > 0) & self.wanted[before])
        every = common.min() if len(common) else _NONE
        if not len(place):
            if not self.carry:
                return
            np.minimum(self.least, every, out=self.least)
            return
        symbol = self.text[before[place]]
        order = np.argsort(symbol, kind="stable")
        place, symbol = place[order], symbol[order]
        moved = before[place]
        cuts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        if not self.carry:
            self._push(symbol, cuts, moved, np.zeros(len(place), np.uint8))
            return
        start = np.empty(len(place), np.int64)
        start[1:] = place[:-1] + 1
        start[cuts] = 0
        table = [common]
        while 2 * len(table[0]) >= 1 << (len(table) + 1) and len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        width = place - start + 1
        level = np.log2(width).astype(np.int64)
        least = np.empty(len(place), np.uint8)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(table[k][start[at]], table[k][place[at] - (1 << k) + 1])
        least[cuts] = np.minimum(least[cuts], self.least[symbol[cuts]])
        shared = np.minimum(least, DEPTH - 1) + np.uint8(1)
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], _NONE)
        last = np.append(cuts[1:], len(place)) - 1
        np.minimum(self.least, every, out=self.least)
        self.least[symbol[last]] = after[place[last] + 1]
        self._push(symbol, cuts, moved, shared)

    def _push(self, symbol: np.ndarray, cuts: np.ndarray, moved: np.ndarray, shared: np.ndarray) -> None:
        edges = [*cuts.tolist(), len(moved)]
        for c, a, b in zip(symbol[cuts].tolist(), edges, edges[1:], strict=False):
            self.queues[c].push(moved[a:b], shared[a:b])


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, up to ``depth``; read in words of eight."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out = np.full(len(a), depth, np.int64)
    open_ = np.arange(len(a))
    for at in range(0, depth, 8):
        x = np.ascontiguousarray(words[a[open_] + at]) != words[b[open_] + at]
        differs = x.any(axis=1)
        out[open_[differs]] = at + x[differs].argmax(axis=1)
        open_ = open_[~differs]
    longest = len(text) - np.maximum(a, b)  # the padding is no text
    return np.minimum(np.minimum(out, longest), depth).astype(np.uint8)


def _opened(block: tuple[np.ndarray, np.ndarray], last: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of a byte's queue; the first tuple of a byte shares nothing with the one before."""
    if last >= 0:
        return block
    common = block[1].copy()
    common[0] = 0
    return block[0], common


def _induce(text: np.ndarray, smaller: np.ndarray, run: np.ndarray, lms: Callable[[int], tuple[np.ndarray, np.ndarray]], memory: int, carry: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both scans; yields blocks of (positions, common prefixes) in order, smallest suffix first.

    ``lms`` gives the LMS positions of a byte in order, with their common prefixes; without
    ``carry`` the prefixes are left at zero.
    """
    scratch = Scratch(memory)
    n = len(text)
    used = np.flatnonzero(np.bincount(text, minlength=256)).tolist()
    rising, larger, done = ([scratch.queue() for _ in range(256)] for _ in range(3))
    seam = lambda i, j: min(int(run[i]), int(run[j]), DEPTH)
    scan = _Scan(text, ~smaller, rising, carry)
    rising[text[n - 1]].push(np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    for c in used:
        scan.bucket()
        last = -1
        while rising[c]:
            positions, common = _opened(rising[c].pop(), last)
            larger[c].push(positions, common)
            scan.block(positions, common)
            last = int(positions[-1])
        positions, common = lms(c)
        if len(positions):
            common = common.copy()
            common[0] = seam(last, positions[0]) if last >= 0 else 0
            scan.block(positions, common)
    scan = _Scan(text, smaller, rising, carry)
    for c in reversed(used):
        scan.bucket()
        last = -1
        while rising[c]:
            positions, common = _opened(rising[c].pop(), last)
            done[c].push(positions, common)
            scan.block(positions, common)
            last = int(positions[-1])
        carry = None
        for positions, common in larger[c].last_to_first():
            backward = positions[::-1]
            first = (seam(last, backward[0]) if last >= 0 else 0) if carry is None else carry
            scan.block(backward, np.concatenate([np.array([first], np.uint8), common[::-1][:-1]]))
            carry = common[0]
    for c in used:
        last = -1
        while larger[c]:
            positions, common = larger[c].pop()
            last = int(positions[-1])
            yield positions, common
        carry = None
        for positions, common in done[c].last_to_first():
            forward = positions[::-1]
            first = (seam(last, forward[0]) if last >= 0 else 0) if carry is None else carry
            yield forward, np.concatenate([np.array([first], np.uint8), common[::-1][:-1]])
            carry = common[0]
    scratch.close()


def _ranks(names: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The order of the suffixes of a string of names."""
    if names[-1] and int(names.max()) < 256:
        return np.concatenate([p for p, _ in sort_suffixes(names.astype(np.uint8), depth, memory)]).astype(np.int64)
    rank, width = names.astype(np.int64), 1
    while width < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-width or None] = rank[width:] + 1 if width < len(rank) else 0
        distinct, rank = np.unique(rank * (int(rank.max()) + 2) + follow, return_inverse=True)
        if len(distinct) == len(rank):
            break
        width *= 2
    return np.argsort(rank, kind="stable")


def sort_suffixes(text: np.ndarray, depth: int = DEPTH, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the suffix before), in suffix order, of a ``uint8`` text."""
    n = len(text)
    if not n:
        return
    cuts = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1, [n]])
    ends = np.repeat(cuts[1:], np.diff(cuts))
    run = np.minimum(ends - np.arange(n), 255).astype(np.uint8)
    smaller = np.zeros(n, bool)
    inner = ends < n
    smaller[inner] = text[ends[inner]] > text[inner]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1

    def grouped(positions: np.ndarray, common: np.ndarray):
        symbol = text[positions]
        at = np.searchsorted(symbol, np.arange(257))
        return lambda c: (positions[at[c] : at[c + 1]], common[at[c] : at[c + 1]])

    if len(lms) > 1:
        first = lms[np.argsort(text[lms], kind="stable")].astype(np.int32)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = []
        for positions, _ in _induce(text, smaller, run, grouped(first, np.zeros(len(first), np.uint8)), memory, carry=False):
            found.append(positions[is_lms[positions]])
        order = np.concatenate(found).astype(np.int64)
        # Names: equal LMS substrings (to the next LMS, inclusive) share one.
        end = np.append(lms[1:] + 1, n)
        hashes = span_hashes(prefix_hashes(text), lms, end) + (end - lms).astype(np.uint64)
        hashes[-1] += np.uint64(1)  # the last runs into the end of the text: like no other
        number = np.empty(n, np.int32)
        number[lms] = np.arange(len(lms))
        at = number[order]
        names = np.empty(len(lms), np.int64)
        names[at] = np.cumsum(np.concatenate([[0], hashes[at][1:] != hashes[at][:-1]]))
        if names[at[-1]] + 1 < len(lms):
            order = lms[_ranks(names, depth, memory)]
        lms = order
    common = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        common[1:] = common_prefixes(text, lms[1:], lms[:-1])
    yield from _induce(text, smaller, run, grouped(lms.astype(np.int32), common), memory)
