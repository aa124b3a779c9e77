"""Texts as numpy arrays: UTF-8 bytes, words, span hashes, packed integer lists.

Everything here works on one block of documents inside a task. Hashes are polynomials modulo 2**64
over random byte values, read off prefix sums, so a hash costs the same for a word or a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time; keeps the temporary arrays small whatever the block holds.
PIECE = 1 << 18
#: Stands for a missing document id: it comes after every other id.
NO_ID = np.iinfo(np.int64).max
_ONE = np.uint64(1)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def _odd_inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self._bases = (base, _odd_inverse(base))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self._tables[0]) < n:
            for i, base in enumerate(self._bases):
                steps = np.full(max(n, 2 * len(self._tables[i])), base, np.uint64)
                steps[0] = 1
                self._tables[i] = np.multiply.accumulate(steps)
        return self._tables


class SpanHash:
    """64-bit hashes of any spans of a sequence of values below 256, or of 64-bit values."""

    def __init__(self, seed: int):
        self._bytes = _random(seed, 256)
        self._powers = _Powers(0x9E3779B97F4A7C15 if seed % 2 else 0xD6E8FEB86659FD93)

    def sums(self, values: np.ndarray) -> np.ndarray:
        if values.dtype == np.uint8:
            values = self._bytes[values]
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers.upto(len(out))[0][: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._powers.upto(len(sums))[1][starts])

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of ``width`` values."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self.sums(values)
        return mix((sums[width:] - sums[:n]) * self._powers.upto(len(sums))[1][:n])

    def at(self, values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each start on, equal to that of ``windows``."""
        powers, out = self._powers.upto(width)[0], np.zeros(len(starts), np.uint64)
        for i in range(width):
            out += self._bytes[values[starts + i]] * powers[i]
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


FIRST, SECOND = SpanHash(1), SpanHash(2)

#: The bytes that separate words: space and \t \n \v \f \r.
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the n + 1 places between them. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def ids(column) -> np.ndarray:
    """Document ids, NO_ID for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def pieces(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the document of each."""
    n = len(data)
    solid = _SOLID[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(bounds, starts, "right") - 1


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows, given by their (distinct) starts."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n], dtype=np.int32) > 0


_JUMP = 65535


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted list of integers as 16-bit gaps; 65535 only moves on."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    jumps = gaps // _JUMP
    if not jumps.any():
        return gaps.astype("<u2").tobytes()
    out = np.full(len(gaps) + int(jumps.sum()), _JUMP, "<u2")
    out[np.cumsum(jumps + 1) - 1] = gaps % _JUMP
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2")
    return np.cumsum(gaps, dtype=np.int64)[gaps != _JUMP]


def pack_longs(values: np.ndarray) -> bytes:
    """64-bit integers by byte position, so that small ones compress to little."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Hash ranges of equal size, numbered from 0; sorted hashes have sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
