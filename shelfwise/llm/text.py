"""Vectorised text helpers for Arrow batches inside Spark tasks.

Texts stay one UTF-8 byte buffer per chunk of documents; words, word hashes
and shingle hashes are numpy arrays over that buffer, so the cost is a few
array passes per byte and the memory is bounded by the chunk size (one
document at least, since a text is never cut).

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)

# byte tables
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IDENTITY = np.arange(256, dtype=np.uint8)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes inside the given inclusive ranges."""
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


#: words between white space: ``[^\x20\x09-\x0D]+``
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: lower-cased words of digits, letters and non-ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
WORD_CHARS = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: the same before lower-casing
WORD_CHARS_RAW = WORD_CHARS | byte_set((0x41, 0x5A))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc only


def release() -> None:
    """Give the memory that finished work has freed back to the system.  Python
    workers live on from stage to stage, and what they hold counts as the
    executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory is released after each of them."""
    for batch in batches:
        yield batch
        del batch
        release()


def text_chunks(batch: pa.RecordBatch, col: str, max_bytes: int = CHUNK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of at most ``max_bytes`` (one row at
    least): ``(first row, end row, bytes, offsets from 0)``."""
    arr = pc.fill_null(batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


_pow: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2^64 (kept for the next chunk)."""
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        p = np.full(size, base, U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if size <= 4 * CHUNK_BYTES:
            _pow[int(base)] = p
        return p[:n]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U(32))
    h = h * _STEP
    h ^= h >> U(29)
    h *= _STEP
    h ^= h >> U(32)
    return h


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums of a byte buffer, to be read by ``slice_hash``."""
    s = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(_BASE_INV, len(b)), out=s[1:])
    return s


def slice_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of the bytes ``start:end`` (equal bytes, equal hash)."""
    return (s[end] - s[start]) * powers(_BASE, len(s))[start]


@dataclass
class Words:
    """Words of a chunk: byte ranges, row (from 0) and position in the row."""

    buf: np.ndarray        # bytes after the case table
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray      # per row: index of its first word
    count: np.ndarray      # per row: number of words

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]

    def hashes(self) -> np.ndarray:
        h = slice_hash(prefix_sums(self.buf), self.start, self.end)
        return mix(h + (self.end - self.start).astype(U))


def words(raw: np.ndarray, off: np.ndarray, keep: np.ndarray, case: np.ndarray = LOWER) -> Words:
    """Maximal runs of ``keep`` bytes (after the case table) in each row."""
    n_rows = len(off) - 1
    buf = case[raw]
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = keep[buf]
    start = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    start[edges] = inside[1:-1][edges]
    stop[edges - 1] = inside[1:-1][edges - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(stop) + 1
    row = np.searchsorted(off, s, "right") - 1
    count = np.bincount(row, minlength=n_rows)
    return Words(buf, s, e, row, np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64), count)


def shingle_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words inside one row, and the index of
    each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _BASE
        acc += h[j:n + j]
    at = np.flatnonzero(row[:n] == row[k - 1:])
    return mix(acc[at]), at


def joined(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each: bytes, word starts, word ends, so
    that words ``i..j`` of a row joined by spaces are ``bytes[start[i]:end[j]]``."""
    length = w.end - w.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    src = np.repeat(w.start - start, length)
    at = np.ones(len(out), bool)
    at[end] = False
    to = np.flatnonzero(at)
    out[to] = w.buf[to + src]
    return out.tobytes(), start, end


def with_column(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch plus new ones."""
    cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep} | more
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
