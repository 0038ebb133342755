"""Sets of word shingles as sorted 64-bit hashes, computed on whole Arrow batches of texts.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a
polynomial over random byte values modulo 2^64, taken from running sums over the batch; a shingle
mixes the hashes of its words. Two different shingles agree with a chance of about 2^-64, which is
what "exact" means for sets compared through their hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes hashed at once; a longer run of text without white space is taken whole.
SEGMENT = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))[_LOWER]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of all words of ``data``; words also end at positions ``first``."""
    hashes, starts = [], []
    blank = _BLANK[data]
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):
            gaps = np.flatnonzero(blank[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(blank[end:])
                end = end + int(more[0]) + 1 if len(more) else len(data)
        word = ~blank[at:end]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = first[np.searchsorted(first, at) : np.searchsorted(first, end)] - at
        begins[cuts] |= word[cuts]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | begins[1:]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(b):
            n = 1 << max(20, (end - at).bit_length())
            power, inverse = _powers(n)
            total = np.zeros(end - at + 1, np.uint64)
            np.cumsum(_VALUE[data[at:end]] * power[: end - at], out=total[1:])
            hashes.append(mix((total[e] - total[b]) * inverse[b]))
            starts.append(b + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each text starts and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text: shingles of ``k`` words; a shorter text
    that has words is one shingle; a text without words has none."""
    data, ends = text_buffers(column)
    sets: list[np.ndarray] = []
    at, n = 0, len(ends) - 1
    while at < n:  # texts of about a segment together, so that little memory is in use at once
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1)
        sets += _sets(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], k)
        at = to
    return sets


def _sets(data: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    hashes, starts = word_hashes(data, ends[:-1])
    bounds = np.searchsorted(starts, ends)
    size = len(hashes) - k + 1
    whole = np.full(max(size, 0), k, dtype=np.uint64)
    for j in range(k if size > 0 else 0):
        whole = mix(whole * U64(_BASE) + hashes[j : j + size])
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            found = np.sort(whole[a : b - k + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            sets.append(found[fresh])
        elif b > a:
            one = np.array([b - a], dtype=np.uint64)
            for j in range(a, b):
                one = mix(one * U64(_BASE) + hashes[j : j + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
