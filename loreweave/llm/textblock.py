"""Whole columns of text as byte arrays: words, their hashes and shingles in numpy.

A string column of Arrow is one buffer of UTF-8 bytes with offsets, so words of
thousands of documents are found and hashed by a few array operations. Blocks
bound the temporary arrays; a text of any length is covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_B = U(0x9E3779B97F4A7C15)
_K = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93))
np.seterr(over="ignore")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * _K[0]
    h = h ^ (h >> U(27))
    h = h * _K[1]
    return h ^ (h >> U(31))


def columns(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column with each row's start and end; null is empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off[:-1], off[1:]


def slices(arr: pa.Array, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of a text array of about ``size`` bytes; none is empty."""
    if len(arr):
        _, _, ends = columns(arr)
        base, i = ends[0] - (len(arr[0].as_buffer()) if arr[0].is_valid else 0), 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else base) + size, "right")))
            yield arr.slice(i, j - i)
            i = j


def is_space(b: np.ndarray) -> np.ndarray:
    """Bytes of ``[\\x20\\x09-\\x0D]``."""
    return (b == 32) | ((b >= 9) & (b <= 13))


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def _hash_block(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of b[s:e] for words that cover disjoint rising ranges."""
    at = np.arange(len(b), dtype=np.int64)
    ix = np.zeros(len(b), np.int64)
    ix[starts] = starts
    ix = at - np.maximum.accumulate(ix)
    power = np.empty(int((ends - starts).max()) + 1, np.uint64)
    power[0], power[1:] = U(1), _B
    power = np.cumprod(power)
    inside = np.zeros(len(b) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    val = (b.astype(np.uint64) + U(1)) * power[np.minimum(ix, len(power) - 1)]
    val *= np.cumsum(inside[:-1]).astype(np.uint64)
    return mix(np.add.reduceat(val, starts) + (ends - starts).astype(np.uint64) * _K[2])


def blocks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, int]]:
    """(first row, last row + 1, cut): rows of about ``size`` bytes together, a longer row alone in pieces.

    ``cut`` is -1 for whole rows, else the piece's first byte; pieces end at white space.
    """
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        if j == i + 1 and ends[i] - starts[i] > 2 * size:
            cut = int(starts[i])
            while cut < ends[i]:
                yield i, i + 1, cut
                cut = _next_cut(buf, cut, int(ends[i]), size)
        else:
            yield i, j, -1
        i = j


def _next_cut(buf: np.ndarray, cut: int, end: int, size: int) -> int:
    at = cut + size
    while at < end:
        gap = np.flatnonzero(is_space(buf[at : at + 4096]))
        if len(gap):
            return min(end, at + int(gap[0]))
        at += 4096
    return end


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, gap: Callable = is_space, size: int = BLOCK, places: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64) of each maximal run of bytes that are no ``gap``, in order; and each row's first word and end.

    White space must be part of ``gap``. ``places`` gets arrays of the words' first bytes.
    """
    hashes, counts = [], np.zeros(len(starts), np.int64)
    for i, j, cut in blocks(buf, starts, ends, size):
        lo, hi = (int(starts[i]), int(ends[j - 1])) if cut < 0 else (cut, _next_cut(buf, cut, int(ends[i]), size))
        b = buf[lo:hi]
        if lower:
            b = lower_ascii(b)
        solid = ~gap(b)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        if cut < 0:
            edge = starts[i:j] - lo
            edge = edge[edge < len(b)]
            first[edge] = solid[edge]
            close = ends[i:j] - lo - 1
            close = close[close >= 0]
            last[close] = solid[close]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        hashes.append(_hash_block(b, s, e))
        if places is not None:
            places.append(s + lo)
        if cut < 0:
            counts[i:j] += np.searchsorted(s, ends[i:j] - lo) - np.searchsorted(s, starts[i:j] - lo)
        else:
            counts[i] += len(s)
    end = np.cumsum(counts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), end - counts, end


def shingles(h: np.ndarray, first: np.ndarray, end: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingle hashes; a shorter row has its whole sequence as one, an empty row none."""
    if len(h) >= k:
        s = h[: len(h) - k + 1] * _K[0]
        for i in range(1, k):
            s = mix(s + h[i : len(h) - k + 1 + i] * _K[i % 3])
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    out = []
    for a, z in zip(first.tolist(), end.tolist(), strict=True):
        if z - a >= k:
            out.append(np.unique(s[a : z - k + 1]))
        elif z > a:
            one = U(z - a)
            for x in h[a:z]:
                one = mix(np.array([one * _K[1] + x * _K[2]], np.uint64))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
