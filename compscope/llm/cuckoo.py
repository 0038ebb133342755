"""A cuckoo filter over 128-bit digests: a set that can forget (Fan, Andersen, Kaminsky and
Mitzenmacher 2014).

A digest is two 64-bit words. Its 16-bit fingerprint may lie in any of four slots of two buckets,
and each of the two follows from the other and the fingerprint, so entries can be moved, and removed
again, without the digest. An absent digest is found by mistake with a chance of about 8 / 65,535;
a present one is never missed.
"""

from __future__ import annotations

import numpy as np

from .shingles import U64, mix

SLOTS = 4
# Entries that are moved for one insertion before the filter counts as full.
KICKS = 500
# Share of the slots that a new filter plans to fill.
LOAD = 0.85


class CuckooFilter:
    def __init__(self, table: np.ndarray) -> None:
        """``table``: fingerprints, a row of ``SLOTS`` per bucket; 0 is a free slot."""
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """An empty filter with room for ``n`` digests."""
        buckets = 1
        while buckets * SLOTS * LOAD < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets."""
        mark = (h2.view(np.uint64) >> U64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        mask = U64(len(self.table) - 1)
        # Upper bits: the lower ones choose the shard.
        first = (h1.view(np.uint64) >> U64(24)) & mask
        return mark, first.astype(np.int64), (first ^ (mix(mark.astype(np.uint64)) & mask)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h1, h2)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Add digests that are not in the set; False if there is no room, after which the filter
        must be built again larger."""
        mark, a, b = self._places(h1, h2)
        return all(self._put(*p) for p in zip(mark.tolist(), a.tolist(), b.tolist()))

    def _put(self, mark: int, a: int, b: int) -> bool:
        table, mask = self.table, len(self.table) - 1
        for bucket in (a, b):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        bucket = b
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, table[bucket, slot] = int(table[bucket, slot]), mark
            bucket ^= int(mix(np.array([mark], np.uint64))[0]) & mask
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = mark
                return True
        return False

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out digests that were inserted before; others must not be asked for, since they may
        share the fingerprint of one that stays. That the set holds them is for the caller to know."""
        mark, a, b = self._places(h1, h2)
        for m, i, j in zip(mark.tolist(), a.tolist(), b.tolist()):
            for bucket in (i, j):
                found = np.flatnonzero(self.table[bucket] == m)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("a digest to remove is not in the filter")


def filled(h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
    """A filter of distinct digests, enlarged until all find room."""
    size = len(h1)
    while True:
        new = CuckooFilter.sized(size)
        if new.insert(h1, h2):
            return new
        size = max(2 * size, SLOTS)
