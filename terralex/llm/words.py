"""Vectorised splitting and hashing of words over Arrow string arrays.

Texts are read in place from Arrow's buffers. A batch is worked through in slices of whole documents of about
``SLICE`` bytes, and bytes are hashed in pieces of about ``PIECE``, which bounds the working memory; one very long
document makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
PIECE = 1 << 19

_BYTES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~2 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of words in running text: all but space and \t\n\v\f\r.
TEXT_WORD = np.ones(256, bool)
TEXT_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of alphanumeric words: ASCII letters and digits, and all of UTF-8 beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, PIECE + 1024)
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a slice: documents ``first`` to ``first + len(offsets) - 2`` of the batch own words offsets[i]:offsets[i+1]."""

    first: int
    data: np.ndarray  # the slice's bytes
    bounds: np.ndarray  # of documents in data
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        at = starts[i]
        piece = data[at : ends[j - 1]]
        if lower:
            piece = _LOWER[piece]
        power, inverse = _power(len(piece) + 1)
        with np.errstate(over="ignore"):
            total = np.empty(len(piece) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTES[piece] * power[: len(piece)], out=total[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, bytes, bounds in them)."""
    offsets, data = string_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(column: pa.Array, word: np.ndarray = TEXT_WORD, lower: bool = True) -> Iterator[Words]:
    """Words of each slice of a string array."""
    for i, j, data, bounds in slices(column):
        inside = word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[heads] = inside[heads]  # a word never crosses documents
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:]
        finishes[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = inside[bounds[1:][bounds[:-1] < bounds[1:]] - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        yield Words(i, data, bounds, starts, ends, np.searchsorted(starts, bounds), _hashes(data, starts, ends, lower))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words, and which of them lie in one document (by their first word)."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += w.hashes[i : i + n] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1)
        left = w.offsets[1:][w.doc[:n]] - np.arange(n)
        return mix(total), left >= k
