"""Whole Arrow batches of texts as NumPy arrays: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SPAN = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(0x9E3779B97F4A7C15 | 1, _SPAN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that makes every bit depend on every other."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, bounds): rows of about ``most`` bytes at a time, one row at
    least. ``bounds`` has rows + 1 places in the bytes; a null row is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of anything but ASCII white space, none across a bound."""
    solid = ~_WHITE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = inner[inner > 0] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans (not empty, in order, apart from each other)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if int(lengths.sum()) == len(data) and int(starts[0]) == 0:
        held, at = data, starts
    else:
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] = 1
        np.subtract.at(keep, ends, 1) if np.any(np.diff(ends) == 0) else keep.__setitem__(ends, keep[ends] - 1)
        held = data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
        at = np.cumsum(lengths) - lengths
    if lower:
        held = _LOWER[held]
    place = np.arange(len(held), dtype=np.int64) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        weighted = (held.astype(np.uint64) + np.uint64(1)) * _POWERS[place & (_SPAN - 1)]
        if len(place) and int(lengths.max()) > _SPAN:
            weighted *= mix((place // _SPAN).astype(np.uint64)) | np.uint64(1)
        return mix(np.add.reduceat(weighted, at) + lengths.astype(np.uint64))
