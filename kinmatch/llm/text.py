"""Words, lines and n-grams of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Everything works on UTF-8 bytes. White space is ASCII, so words and lines can be cut on bytes
without decoding. Hashes are polynomial sums modulo 2^64 taken from one running sum, mixed
with the length; equal spans always agree, and different spans collide with odds of 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def tidy() -> None:
    """Give freed memory back; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library can
        pass


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory goes back when they end."""
    try:
        yield from batches
    finally:
        tidy()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and where each text starts; null is empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that aren't white space."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:-1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(bounds, begin, "right") - 1


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; a text without a newline is one line."""
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([bounds[:-1], cuts + 1]), kind="stable")
    inner = np.searchsorted(bounds, cuts, "right") - 1
    row = np.sort(np.concatenate([np.arange(len(bounds) - 1), inner]), kind="stable")
    counts = np.bincount(row, minlength=len(bounds) - 1)
    ends = np.empty(len(begin), np.int64)
    ends[:-1] = begin[1:] - 1
    tail = np.cumsum(counts) - 1
    ends[tail] = bounds[1:]
    return begin, ends, row


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans come in order and don't overlap."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        base = begin[at]
        to = max(at + 1, int(np.searchsorted(end, base + CHUNK_BYTES, "right")))
        stop = end[to - 1]
        up, down = _tables(int(stop - base) + 1)
        sums = np.zeros(int(stop - base) + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
        s, e = begin[at:to] - base, end[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mixed(out)


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every n neighbouring words of a row, and the index of its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    total = hashes[at].copy()
    for j in range(1, n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[at + j]
    return mixed(total), at
