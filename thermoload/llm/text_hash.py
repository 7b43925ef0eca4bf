"""Words and their 64-bit hashes straight from the UTF-8 buffer of a string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import by_value

P1 = np.uint64(0x9E3779B97F4A7C15)
P2 = np.uint64(0xBF58476D1CE4E5B9)
S32 = np.uint64(32)
CHUNK = 1 << 18            # bytes of text hashed at a time
_BASE = 0xD6E8FEB86659FD93  # odd: invertible modulo 2^64
_TABLES: dict[int, tuple] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S32)) * P2
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


def tables(n: int) -> tuple:
    """Byte values with A-Z as a-z, white space flags, and powers of the base and its inverse
    for texts of n bytes at most."""
    if not _TABLES or next(iter(_TABLES)) < n:
        value = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64)
        value[ord("A"):ord("Z") + 1] = value[ord("a"):ord("z") + 1]
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _TABLES.clear()
        _TABLES[n] = (value, space, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    return next(iter(_TABLES.values()))


def text_chunks(column: pa.Array):
    """(bytes, edges) of runs of whole texts of about CHUNK bytes; the texts lie end to end, cut
    at the edges. A null text is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield raw[int(offsets[i]):int(offsets[j])], offsets[i:j + 1] - offsets[i]
        i = j


def word_hashes(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of every word (A-Z as a-z), each text's first word number, and the words' first
    and last byte. Two of n words share a hash with probability n*n/2^65."""
    value, space, power, inverse = tables(max(len(b), CHUNK))
    ink = ~space[b]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = edges[(edges > 0) & (edges < len(b))]   # a word ends where its text ends
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.cumsum(value[b] * power[:len(b)])
    words = sums[ends]
    words[starts > 0] -= sums[starts[starts > 0] - 1]
    words = mix(words * inverse[starts])            # a word's hash does not depend on its place
    return words, np.searchsorted(starts, edges), starts, ends


by_value(__name__)
