"""Vectorised word and hash helpers over Arrow string batches (numpy, inside tasks)."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a single longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``max_bytes`` of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give memory back that is free but that the allocators of Arrow and C keep for the worker's later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut or put together so that each holds about ``max_bytes`` of ``column``; a longer row stands alone."""
    held, size = [], 0
    for batch in slices(batches, column, max_bytes):
        n = int(pc.sum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).as_py() or 0)
        if held and size + n > max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and where each row starts (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: The bytes between words, \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that ``space`` doesn't mark), and the first word number of each row."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    inside = ~space[data]
    gap[1:n] = ~inside[: n - 1] if n else True
    gap[offsets] = True
    starts = np.flatnonzero(inside & gap[:n])
    after = np.ones(n, bool)
    if n:
        after[: n - 1] = ~inside[1:]
        cut = offsets[(offsets > 0) & (offsets <= n)] - 1
        after[cut] = True
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes from which on a span is hashed by itself, so that one long span doesn't make a round of its own for each of its words.
_LONG_SPAN = 512


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]], eight bytes a round, each round mixed; long spans by blake2b.

    A polynomial in the bytes modulo a power of two would not do: it has colliding spans
    of 2,048 letters whatever its base.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _ODD[0] + _ODD[1])
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    left = np.where(size < _LONG_SPAN, size, 0)
    rows, at = np.flatnonzero(left), 0
    while len(rows):
        rest = left[rows] - at
        got = words[starts[rows] + at]
        short = rest < 8
        got[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[rows] = mix(out[rows] * _ODD[2] + mix(got ^ _ODD[3]))
        at += 8
        rows = rows[rest > 8]
    for i in np.flatnonzero(size >= _LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every k following word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _ODD[i % len(_ODD)] + np.uint64(i)
    return mix(total)


def short_hash(words: np.ndarray) -> np.uint64:
    """Hash of a sequence of fewer than k words; its length keeps it apart from shingles."""
    total = np.array([len(words)], np.uint64)
    for i in range(len(words)):
        total = mix(total + words[i : i + 1] * _ODD[i % len(_ODD) : i % len(_ODD) + 1])
    return mix(total ^ np.uint64(0x5851F42D4C957F2D))[0]
