"""Vectorised word and shingle hashes over Arrow batches of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Keeps the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets in them) over a string column; null rows are empty."""
    data, offsets = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run does not cross the end of a row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]``, eight bytes mixed in at a time, A-Z lower-cased.

    Words of equal length up to eight bytes never share a hash; longer ones do so by chance alone, whatever their pattern.
    """
    lowered = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=lowered[: len(data)])
    eight = np.ndarray(len(data) + 1, "<u8", lowered, strides=(1,))
    n = ends - starts
    out = mix(n.astype(np.uint64) * _STEP)
    at = np.arange(len(starts))
    for k in range(0, LONG_WORD, 8):
        at = at[n[at] > k] if k else at
        if not len(at):
            return out
        part = eight[starts[at] + k] & _FIRST[np.minimum(n[at] - k, 8)]
        out[at] = mix(out[at] * _STEP ^ part)
    for i in at[n[at] > LONG_WORD].tolist():
        digest = hashlib.blake2b(lowered[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, and the row offsets in them.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.
    """
    starts, ends = runs(~_SPACE[data], offsets)
    return hashed(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, over row ends too."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _ORDER[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct signed 64-bit shingle hashes of each row; the whole sequence where a row has fewer words."""
    hashes, at = words(data, offsets)
    all_grams = grams(hashes, size).view(np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_grams[a : b - size + 1])
        elif b > a:
            yield grams(hashes[a:b], b - a).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
