"""Whole-batch text work in numpy: bytes, words and hashes of many documents at once."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time; one longer document makes a slice of its own.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (or inverse powers) of the hash base modulo 2**64."""
    base = _INVERSE if inverse else _BASE
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1, -(-n >> 18)) << 18
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= SLICE_BYTES * 4:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Texts:
    """The UTF-8 bytes of a run of documents, one after the other; a null text is empty.

    first is the index of the first document in its batch, offs has len+1 byte offsets.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int = 0):
        self.data, self.offs, self.first = data, offs, first

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offs)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of the runs of other than ASCII white space, and the word offset of each document."""
        return self.runs(~SPACE[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where inside holds; runs never cross documents."""
        n = len(self.data)
        head = np.zeros(n + 1, bool)
        head[1:n] = inside[1:] & ~inside[:-1]
        tail = np.zeros(n + 1, bool)
        tail[1:n] = inside[:-1] & ~inside[1:]
        if n:
            tail[n] = inside[-1]
            at = self.offs[:-1][self.lengths() > 0]
            head[at] = inside[at]
            tail[at[1:]] = inside[at[1:] - 1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
        return starts, ends, np.searchsorted(starts, self.offs)

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums that hash_of() turns into hashes of byte ranges."""
        data = self.data if data is None else data
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
        return out


def hash_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes, wherever they stand."""
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + lengths * np.uint64(0xC2B2AE3D27D4EB4F))


def roll(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(words) - n + 1 of them)."""
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Runs of whole documents with at most limit bytes together (or one longer document)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def release() -> None:
    """Give memory that is free in this process back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a task's batches that releases memory at its end: Spark keeps Python workers for later tasks, and else each keeps all it has ever used."""

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def each(column: pa.Array) -> Iterator[Texts]:
    """The documents one by one."""
    for texts in slices(column):
        for i, (a, b) in enumerate(zip(texts.offs, texts.offs[1:], strict=False)):
            yield Texts(texts.data[a:b], np.array([0, b - a]), texts.first + i)
