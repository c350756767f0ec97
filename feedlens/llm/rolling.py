"""Words, shingles and windows of whole Arrow batches at once: polynomial (Rabin-Karp) hashes with numpy.

A batch is cut into slices of half a megabyte, or some thousand rows, between documents, so that working memory is
bounded by the slice (or by one document that is longer). All hashes are 64-bit, taken modulo 2**64 with odd bases, and
mixed so that single bits of the input reach all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SLICE_ROWS = 1 << 13
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n, modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = found
    return found


def hash_of_ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of values[start:end] for each range, the same for the same content at any place."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values))[: len(values)], out=total[1:])
    inverse = _power(pow(base, -1, 1 << 64), len(values))
    return (total[end] - total[start]) * inverse[start]


@dataclass
class Slice:
    """Some documents of a batch: their rows in it, their bytes and where each begins."""

    first: int
    data: np.ndarray
    offset: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offset) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.offset[k] : self.offset[k + 1]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a batch's texts (null: empty) between documents."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(max(at + 1, int(np.searchsorted(offset, offset[at] + most, "right")) - 1), at + SLICE_ROWS)
        yield Slice(at, data[offset[at] : offset[to]], offset[at : to + 1] - offset[at])
        at = to


@dataclass
class Words:
    """All words of a slice in order: byte ranges, the document of each, their hashes, and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(s: Slice, lower: bool = False) -> Words:
    """Words are runs of bytes other than space and \\x09-\\x0D; lower folds A-Z alone."""
    data = _LOWER[s.data] if lower else s.data
    n = len(data)
    inside = ~_WHITE[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = s.offset[:-1][s.offset[:-1] < n]
        starts[edge] = inside[edge]
        edge = s.offset[1:][s.offset[1:] > 0] - 1
        ends[edge] = inside[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, s.offset)
    doc = np.repeat(np.arange(s.rows), np.diff(first))
    return Words(start, end, doc, mixed(hash_of_ranges(_BYTES[data], start, end, _BASE) + (end - start).astype(np.uint64)), first)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of `size` consecutive words of one document starts, and its Rabin-Karp hash."""
    if len(w.hash) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[size - 1 :] == w.doc[: len(w.doc) - size + 1])
    return at, mixed(hash_of_ranges(w.hash, at, at + size, _WORD_BASE))


def least_of_each(values: np.ndarray, size: int) -> np.ndarray:
    """The least of values[i : i + size] for each i, by doubling."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < size:
        more = size - width
        out = np.minimum(out[: len(out) - more], out[more:])
    return out


def spread(x: np.ndarray) -> np.ndarray:
    """The first permutation: 64-bit shingle hashes to the 32-bit universe."""
    return (mixed(x) >> np.uint64(32)).astype(np.uint32)


BLOCK = 150_000


def circulant_minhash(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash (Li and Li, "C-MinHash", 2022): one row of coordinates for each non-empty set.

    The first permutation (spread) scatters the shingles over the universe of 32-bit numbers; coordinate k is the
    least value of the second permutation, circularly shifted by k. starts: where each set begins in shingles.
    Sets are taken in blocks that stay in a core's cache.
    """
    out = np.empty((len(starts), coordinates), np.uint32)
    ends = np.append(starts[1:], len(shingles))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        at = spread(shingles[starts[first] : ends[last - 1]])
        inner = starts[first:last] - starts[first]
        x, y = np.empty_like(at), np.empty_like(at)
        for k in range(coordinates):
            np.subtract(at, np.uint32(k), out=x)
            np.multiply(x, np.uint32(0x9E3779B1), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA77), out=x)
            out[first:last, k] = np.minimum.reduceat(x, inner)
        first = last
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates; the band's number is part of its key."""
    n, k = signature.shape
    cut = signature[:, : k - k % rows].reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * np.uint64(_BASE), cut.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(_WORD_BASE) + cut[:, :, r])
    return key


def minhash(points: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash: one row of coordinates for each non-empty set of well-mixed 32-bit numbers. Coordinate k is the least value
    of its own permutation of them, the product with an odd number modulo 2**32. starts: where each set begins."""
    out = np.empty((len(starts), coordinates), np.uint32)
    odd = (mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(_BASE)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    ends = np.append(starts[1:], len(points))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        at = points[starts[first] : ends[last - 1]]
        inner, x = starts[first:last] - starts[first], np.empty_like(at)
        for k in range(coordinates):
            np.multiply(at, odd[k], out=x)
            out[first:last, k] = np.minimum.reduceat(x, inner)
        first = last
    return out


def parities(shingles: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """For each set one bit a place, packed: whether an odd number of its shingles name the place. Shingles that two sets
    share cancel out, so the places in which their parities differ bound from below, for certain, how many they don't."""
    ends = np.append(starts[1:], len(shingles))
    bit = (spread(shingles ^ np.uint64(_BASE)) & np.uint32(bits - 1)).astype(np.int64)
    out = np.empty((len(starts), bits // 64), np.uint64)
    for first in range(0, len(starts), 256):
        last = min(first + 256, len(starts))
        place = np.repeat(np.arange(last - first) * bits, ends[first:last] - starts[first:last]) + bit[starts[first] : ends[last - 1]]
        odd = (np.bincount(place, minlength=(last - first) * bits) & 1).astype(np.uint8)
        out[first:last] = np.packbits(odd.reshape(-1, bits), axis=1).view(">u8")
    return out


def distinct_of_each(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each range first[k] : first[k + 1], sorted within it, and where each begins; sorts in place."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[1:] > first[:-1]]] = True
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return values[new], total[first]


def list_array(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """array<bigint> rows of the given lengths."""
    offset = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offset[1:])
    return pa.ListArray.from_arrays(pa.array(offset), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
