"""Texts of an Arrow batch seen as numpy arrays: bytes, words, fixed-length windows and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
# [\x20\x09-\x0D]: bytes that never occur inside a longer UTF-8 sequence
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give memory that is free inside this worker back to the system, as workers outlive the tasks they serve."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift-multiply finaliser, a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def row_groups(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` units each; a longer row forms a range of its own."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def word_bounds(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of bytes that don't separate) in ``raw[at[0]:at[-1]]``, and word counts per row."""
    lo, hi = int(at[0]), int(at[-1])
    gap = separator[raw[lo:hi]]
    n = hi - lo
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = ~gap
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[at - lo] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, at - lo))
    return starts + lo, ends + lo, counts


def _weights(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(salt)) | U64(1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: bytes weighted by their place in the word, summed modulo 2**64 and mixed with the length."""
    lengths = ends - starts
    out = np.empty(len(starts), U64)
    for first, last in row_groups(lengths, 1 << 19):
        own = lengths[first:last]
        lead = np.concatenate([[0], np.cumsum(own)[:-1]])
        place = np.arange(int(own.sum())) - np.repeat(lead, own)
        letters = raw[place + np.repeat(starts[first:last], own)]
        if lower:
            letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
        values = (letters.astype(U64) + U64(1)) * _weights(int(own.max()), salt)[place]
        out[first:last] = np.add.reduceat(values, lead)
    return mix(out + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash (base ``BASE`` modulo 2**64) of every ``size`` consecutive values, built from hashes of doubled length."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    power = lambda k: U64(pow(BASE, k, 1 << 64))
    whole, done, length, block = None, 0, 1, values
    bits = size
    parts = []
    while bits:
        if bits & 1:
            parts.append((length, block))
        bits >>= 1
        if bits:
            block = block[:-length] * power(length) + block[length:]
            length *= 2
    for length, block in parts:
        piece = block[done : done + n]
        whole = piece.copy() if whole is None else whole * power(length) + piece
        done += length
    return whole


def window_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    n = len(values) - size + 1
    length, block = 1, values
    while length * 2 <= size:
        block = np.minimum(block[:-length], block[length:])
        length *= 2
    return np.minimum(block[:n], block[size - length : size - length + n])


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """First index of each run of equal values in an ordered array."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])


def group_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The run number of each of ``n`` ordered values."""
    mark = np.zeros(n, np.int64)
    mark[starts[1:]] = 1
    return np.cumsum(mark)
