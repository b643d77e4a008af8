"""Words of whole Arrow text columns as arrays of 64-bit hashes.

A word is a run of the bytes 0-9, a-z, A-Z (lower-cased) and 0x80-0xFF, i.e. of
the characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pagewarden.llm.common import pieces

U64 = np.uint64
_TABLE = np.zeros(256, np.uint8)
_TABLE[0x80:] = np.arange(0x80, 0x100)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A)):
    _TABLE[_a : _b + 1] = np.arange(_a, _b + 1)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, U64), dtype=U64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.full(max(n, 2 * len(_POWER)), 0x9E3779B97F4A7C15, U64), dtype=U64)
    return _POWER


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes, 0 where no word is
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray  # uint64
    doc: np.ndarray  # words [doc[i], doc[i + 1]) are row i's

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and the rows' offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _TABLE[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    if len(low):
        cut = offsets[(offsets > 0) & (offsets < len(low))]
        joined = inside[1:] & inside[:-1]
        joined[cut - 1] = False
        first[1:] &= ~joined
        last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    if len(start):
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        value = (low[inside].astype(U64) + U64(1)) * _powers(int(size.max()))[at]
        hashed = mixed(np.add.reduceat(value, np.cumsum(size) - size) ^ (size.astype(U64) << U64(48)))
    else:
        hashed = np.zeros(0, U64)
    return Words(low, start, end, hashed, np.searchsorted(start, offsets))


def each_words(column: pa.Array, limit: int = 2_000_000):
    """(first row, Words) for ranges of rows of about limit bytes; a longer text is a range of its own."""
    data, offsets = utf8(column)
    for a, b in pieces(len(column), np.diff(offsets), limit):
        yield a, words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions without k words after them are left out."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0x100000001B3) + hashed[j : j + n]
    return mixed(out)
