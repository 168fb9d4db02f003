"""Vectorised text primitives shared by the operators, used inside Spark tasks.

A batch of documents is one contiguous UTF-8 buffer plus document offsets (the
Arrow string layout), so tokenising and hashing are a handful of numpy passes
over the whole batch instead of a Python loop per document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII upper case to lower case, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of a word after lower-casing: digits, a-z and all of non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n, kept for the next batch."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, dtype=U64)
        down = np.full(size, _INVERSE, dtype=U64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return _powers[size]


class RangeHash:
    """Hash of any byte range of a buffer in constant time (prefix sums)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=U64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0x9FB21C651E98DF25))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes of text that are looked at together: each takes several arrays of eight times the size.
PIECE = 1 << 17


def release() -> None:
    """Hands freed memory back to the system: a Python worker outlives its tasks, and stages without Python need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def batches(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for each piece of a batch."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    for i, j in pieces(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    del data, offsets
    release()


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words begin before each offset."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHash(data)(starts, ends)


_WEIGHTS = mix(np.arange(11, 75, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words, over the whole buffer (also across documents)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for t in range(k):
        out += hashes[t : t + n] * _WEIGHTS[t]
    return mix(out)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted in it, and their bounds.

    ``counts``: words before each document.  Fewer than k words make one
    shingle of the whole sequence; no words make none.
    """
    lengths = np.diff(counts)
    grams = word_grams(hashes, k)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths - k + 1, 0))
    first = np.repeat(counts[:-1], np.maximum(lengths - k + 1, 0))
    within = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(lengths - k + 1, 0)) - np.maximum(lengths - k + 1, 0), np.maximum(lengths - k + 1, 0))
    values = grams[first + within] if len(owner) else np.zeros(0, dtype=U64)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        whole = np.array([mix(np.array([_whole(hashes[counts[i] : counts[i + 1]])], dtype=U64))[0] for i in short], dtype=U64)
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(lengths) + 1))


def _whole(hashes: np.ndarray) -> int:
    total = len(hashes) * 0x632BE59BD9B4E019
    for t, h in enumerate(hashes):
        total += int(h) * int(_WEIGHTS[t])
    return total & ((1 << 64) - 1)


def keep_columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, pa.Array]:
    return {n: batch.column(batch.schema.get_field_index(n)) for n in names}


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes: planes of equal significance together, then zstandard; small numbers cost little."""
    values = np.ascontiguousarray(values, dtype="<u8")
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """``pack`` of the steps between rising values."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)
