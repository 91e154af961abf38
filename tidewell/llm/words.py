"""Words of whole texts as numpy arrays, a slice of documents at a time.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's 64-bit hash is a sum over its bytes
that prefix sums give for every word at once, finished by an integer mixer; an n-gram's hash is a
mixed combination of its words' hashes. A text of any length is one slice at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word where punctuation counts as space: ASCII other than letters and digits.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (xor-shift-multiply) on uint64; works on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = stream(11, 256)
_BASE = int(stream(12, 1)[0]) | 1
_powers = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = (tables[0], tables[1])
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a slice of documents: document i has words offsets[i]:offsets[i+1]."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    text_offsets: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of more than n bytes, and the hashes of their first n bytes."""
        long = np.flatnonzero(self.ends - self.starts > n)
        starts = self.starts[long]
        inverse = _power_tables(len(self.sums))[1]
        return long, mix64((self.sums[starts + n] - self.sums[starts]) * inverse[starts] + U64(n * 0xA24BAED4963EE407 % 2**64))

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def ngrams(self, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the n words from each position; the last n-1 positions are absent (runs over document ends)."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        weights = stream(101 + seed, n) | U64(1)
        total = self.hashes[:m] * weights[0]
        for j in range(1, n):
            total += self.hashes[j : j + m] * weights[j]
        return mix64(total)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; a null text has no bytes."""
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    found = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_valid()), np.diff(found), 0)
        if sizes.sum() != found[-1] - found[0]:  # nulls over bytes: rare, so copy
            texts = column.fill_null("").cast(pa.large_string())
            return text_buffers(pa.array(texts.to_pylist(), pa.large_string()))
    return found, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, lower: bool, size: int = 1 << 20, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The documents of a column, in slices of about ``size`` bytes."""
    offsets, data = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, at, space)
        at = to


def split(data: np.ndarray, offsets: np.ndarray, lower: bool, first: int = 0, space: np.ndarray = _SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.add.accumulate(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(first, data, starts, ends, np.searchsorted(starts, offsets), offsets, hashes, sums)
