"""Token ids of words by 64-bit hash, in a fixed number of bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from panelwright.llm.words import U

_PLACE = 28  # bytes of a place: its hash and entry number, and half an entry with five ids of two bytes


class IdTable:
    """Hash -> ids. Each hash has two places, with two places an entry; an entry is a stretch of one pool of ids.

    Everything is allocated at once and takes at most ``most`` bytes (2,000 at least). When entries or pool are used up, ``shrink`` keeps those found
    again since the last time, up to half, and the first ``fixed``. A find's indexes are good until the next ``shrink``.
    """

    def __init__(self, most: int, kind: type, fixed: Sequence[Sequence[int]] = (), ids: int = 0):
        places = 1 << max(6, (most // _PLACE).bit_length() - 1)
        self.entries, self.mask = places // 2, U(places - 1)
        self.kind, self.fixed, self.first = np.dtype(kind), len(fixed), [list(f) for f in fixed]
        self.hash, self.size = np.zeros(self.entries, U), np.zeros(self.entries, np.int32)
        self.start, self.used = np.zeros(self.entries, np.int64), np.zeros(self.entries, bool)
        self.pool = np.zeros(max(ids, 10 * self.entries // self.kind.itemsize), self.kind)
        self.key, self.value = np.zeros(places, U), np.full(places, -1, np.int32)
        self.n = self.filled = 0
        self._append(np.zeros(self.fixed, U), self.first)

    @classmethod
    def for_all(cls, hashes: np.ndarray, ids: Sequence[Sequence[int]], kind: type, fixed: Sequence[Sequence[int]] = ()) -> tuple[IdTable, np.ndarray]:
        """A table as large as these words need, and their indexes."""
        total = sum(map(len, ids)) + sum(map(len, fixed))
        table = cls(_PLACE * 4 * (len(ids) + len(fixed) + 16), kind, fixed, total)
        return table, table.learn(hashes, ids)

    def _append(self, hashes: np.ndarray, ids: Sequence[Sequence[int]]) -> np.ndarray:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total, at = int(size.sum()), np.arange(self.n, self.n + len(ids))
        self.pool[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(ids), self.kind, total)
        self.hash[at], self.size[at], self.used[at] = hashes, size, False
        self.start[at] = self.filled + np.cumsum(size) - size
        self.n, self.filled = self.n + len(ids), self.filled + total
        return at

    def _enter(self, at: np.ndarray) -> None:
        h = self.hash[at]
        one = (h & self.mask).astype(np.int64)
        free = self.value[one] < 0
        self.key[one[free]], self.value[one[free]] = h[free], at[free]
        rest = self.value[one] != at  # taken before, or by another new one
        two = (h[rest] >> U(32) & self.mask).astype(np.int64)
        self.key[two], self.value[two] = h[rest], at[rest]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if the table does not have it."""
        one = (h & self.mask).astype(np.int64)
        found = np.where(self.key[one] == h, self.value[one], -1)
        rest = np.flatnonzero(found < 0)
        two = (h[rest] >> U(32) & self.mask).astype(np.int64)
        found[rest] = np.where(self.key[two] == h[rest], self.value[two], -1)
        self.used[found[found >= 0]] = True
        return found

    def room(self, new: int, ids: int) -> bool:
        return self.n + new <= self.entries and self.filled + ids <= len(self.pool)

    def shrink(self) -> None:
        stay = np.flatnonzero(self.used[: self.n])
        stay = np.concatenate([np.arange(self.fixed), stay[stay >= self.fixed]])[: self.entries // 2]
        stay = stay[np.cumsum(self.size[stay]) <= len(self.pool) // 2]
        pool = self.take(stay)
        self.n, self.filled = len(stay), len(pool)
        self.hash[: self.n], self.size[: self.n] = self.hash[stay], self.size[stay]
        self.pool[: self.filled] = pool
        self.start[: self.n] = np.cumsum(self.size[: self.n]) - self.size[: self.n]
        self.used[:] = False
        self.value[:] = -1
        self._enter(np.arange(self.fixed, self.n))

    def learn(self, hashes: np.ndarray, ids: Sequence[Sequence[int]]) -> np.ndarray:
        """Indexes of new entries, which have to fit (see ``room``)."""
        at = self._append(hashes, ids)
        self._enter(at)
        return at

    def sizes(self, index: np.ndarray) -> np.ndarray:
        return self.size[index].astype(np.int64)

    def take(self, index: np.ndarray) -> np.ndarray:
        """The ids of all entries, one after the other."""
        size = self.sizes(index)
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(index) else 0
        return self.pool[np.arange(total) + np.repeat(self.start[index] - upto + size, size)]

    def look_up(self, h: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, encode: Callable[[str], Sequence[int]]) -> tuple[IdTable, np.ndarray]:
        """Indexes of words ``raw[start:end]`` with hashes ``h``, and the table they are in: this one, with the new words learnt through
        ``encode``, or one of their own if there are more new ones than it can hold.
        """
        index, known = self.find(h), {}

        def told(hashes: np.ndarray, at: np.ndarray) -> list[Sequence[int]]:
            places = zip(start[at].tolist(), end[at].tolist())
            if not known:
                return [encode(raw[a:b].decode()) for a, b in places]
            return [known[x] if x in known else encode(raw[a:b].decode()) for x, (a, b) in zip(hashes.tolist(), places)]

        for again in (False, True):
            missing = np.flatnonzero(index < 0)
            if not len(missing):
                return self, index
            new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            ids = told(new, missing[first])
            if self.room(len(ids), sum(map(len, ids))):
                index[missing] = self.learn(new, ids)[inverse]
                return self, index
            known = dict(zip(new.tolist(), ids))
            if not again:
                self.shrink()
                index = self.find(h)  # entries have moved, and some are gone
        every, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        own, at = IdTable.for_all(every, told(every, first), self.kind, self.first)
        return own, at[inverse]
