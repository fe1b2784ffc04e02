"""Whole Arrow batches of text as flat numpy arrays: words, word hashes and word n-grams.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  UTF-8 never uses these
bytes inside a character, so words of the bytes are the words of the text.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[:, SEPARATORS] = 0
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FAMILY = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_multipliers = np.zeros((2, 0), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place_multipliers(n: int, family: int) -> np.ndarray:
    """An odd multiplier for each place, one independent of the next (splitmix of the place)."""
    global _multipliers
    if _multipliers.shape[1] < n:
        place = np.arange(max(n, 64) * 2, dtype=np.uint64) * _STEP
        _multipliers = mix(place[None] + _FAMILY[:, None]) | np.uint64(1)
    return _multipliers[family, :n]


def tidy(run: Callable) -> Callable:
    """``run`` over batches, or over a group's tables, with freed memory given back when it ends.

    Spark keeps Python workers for later tasks, and an idle one shouldn't hold what a task once needed.
    """

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    def over_group(table):
        try:
            return run(table)
        finally:
            _give_back()

    def over_pair(left, right):
        try:
            return run(left, right)
        finally:
            _give_back()

    if inspect.isgeneratorfunction(run):
        return over_batches
    return over_pair if len(inspect.signature(run).parameters) == 2 else over_group


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text; a longer text is a slice alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch.  start, end: byte places; first: index of each text's first word, with a last entry."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS):
        self.data, self.offsets, self.separators = data, offsets, separators
        inside = ~separators[data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        cuts = offsets[(offsets < len(data))]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False, family: int = 0) -> np.ndarray:
        """64-bit hash of each word; ``lower`` folds A-Z.  The two families are independent of each other.

        A multilinear hash: each byte's random value times a multiplier of its place.  Two words
        of one length collide with a chance of at most 2**-62, whatever their structure.
        """
        if not len(self.start):
            return np.zeros(0, np.uint64)
        longest = int((self.end - self.start).max())
        begin = int(self.start[0])
        data = self.data[begin:]
        gaps = np.diff(np.append(self.start, len(self.data)))
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        place = np.arange(len(data), dtype=kind) - np.repeat((self.start - begin).astype(kind), gaps)
        if int(gaps.max()) > longest + 64:  # a long stretch between words needs no multipliers
            np.minimum(place, longest, out=place)
        times = _place_multipliers(min(int(gaps.max()), longest + 64) + 1, family)
        value = _BYTE_VALUE[family][_LOWER] if lower else _BYTE_VALUE[family].copy()
        value[self.separators] = 0  # what follows a word doesn't count
        value = value[data] * times[place]
        return mix(np.add.reduceat(value, self.start - begin) + (self.end - self.start).astype(np.uint64) * _STEP)


def grams(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hash of ``width`` consecutive words from each place; the last width-1 places are missing."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    times = _place_multipliers(width, family)
    total = hashes[:n] * times[0]
    for k in range(1, width):
        total += hashes[k : k + n] * times[k]
    return mix(total)


def gram_places(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word index) of every gram that lies in one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    lead = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(int(counts.sum())) - np.repeat(lead, counts)
    return owner, first[:-1][owner] + place
