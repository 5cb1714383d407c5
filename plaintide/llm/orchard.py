"""Nearest entry of a codebook by Orchard's search, in whole numbers.

Every entry keeps a list of all entries by their distance from it. A query walks the list
of its nearest entry so far; an entry that is nearer takes over, and the walk goes on in
the list of that one. Entries once compared are marked and not needed again. Whatever lies
beyond twice the current distance from the current entry cannot be nearer than it, so there
the walk ends; ties lie within.

Queries that stand at the same place of the same list walk together: a stretch of the list
is compared with all of them by one matrix product. The product gives
``(distance - |query|^2) * 256 + entry``, whose least value is the nearest entry with the
lowest number, exactly: numbers stay below 2^53, or are Python's where they would not.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no install

#: Most entries of a codebook; a code has two hex digits.
ENTRIES = 256
#: Ends of the stretches of a list that are compared at a time.
_STRETCHES = (0, 64, 192, 256)
_EXACT = 2**53


class Codebook:
    """Entries (n x d, whole numbers) with their sorted neighbour lists."""

    def __init__(self, entries: np.ndarray, largest: int):
        """``largest`` is a bound of the absolute values of entries and queries."""
        n, d = entries.shape
        self.fits = (4 * largest * largest * max(d, 1) + 1) * ENTRIES < _EXACT
        kind = np.float64 if self.fits else object
        self.entries = entries.astype(kind)
        squares = (self.entries * self.entries).sum(axis=1)
        apart = squares[:, None] + squares[None, :] - 2 * (self.entries @ self.entries.T)
        number = np.arange(n).astype(kind)
        self.lists = np.argsort(apart * ENTRIES + number[None, :], axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)
        #: One column per entry in the order of the list: the product with (query, 1) is the key above.
        columns = np.concatenate((-2 * ENTRIES * self.entries, (squares * ENTRIES + number)[:, None]), axis=1)
        self.products = [np.ascontiguousarray(columns[order].T) for order in self.lists]
        self.edges = [(a, min(b, n)) for a, b in zip(_STRETCHES, _STRETCHES[1:]) if a < n]
        #: Entries of each stretch of each list, as marks.
        self.marks = np.zeros((n, len(self.edges), ENTRIES // 64), np.uint64)
        bit = np.uint64(1) << (self.lists % 64).astype(np.uint64)
        for k, (a, b) in enumerate(self.edges):
            for word in range(ENTRIES // 64):
                own = np.where(self.lists[:, a:b] // 64 == word, bit[:, a:b], np.uint64(0))
                self.marks[:, k, word] = np.bitwise_or.reduce(own, axis=1)
        middle = self.entries.sum(axis=0)
        off = n * n * squares - 2 * n * (self.entries @ middle)
        #: The entry nearest the middle; of equal entries the first, which leads the list of each.
        self.start = int(self.lists[int(np.argmin(off)), 0])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the lowest of equals) and its squared distance, for each row of whole numbers."""
        n = len(queries)
        kind = np.float64 if self.fits else object
        own = queries.astype(kind)
        squares = (own * own).sum(axis=1)
        own = np.concatenate((own, np.ones((n, 1), kind)), axis=1)
        at = np.full(n, self.start)
        best = own @ self.products[self.start][:, 0]
        stretch = np.zeros(n, np.int64)
        seen = np.zeros((n, ENTRIES // 64), np.uint64)
        begins = np.array([a for a, _ in self.edges])
        left = np.arange(n)
        while len(left):
            left = self._walked(left, at, stretch, seen, best, squares, begins)
            if not len(left):
                break
            place = at[left] * len(self.edges) + stretch[left]
            order = np.argsort(place, kind="stable")
            left, place = left[order], place[order]
            cuts = np.flatnonzero(np.diff(place)) + 1
            rows = own[left]
            found = np.empty(len(left), kind)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(left)]):
                entry, k = divmod(int(place[a]), len(self.edges))
                low, high = self.edges[k]
                found[a:b] = (rows[a:b] @ self.products[entry][:, low:high]).min(axis=1)
            seen[left] |= self.marks[at[left], stretch[left]]
            # The entry number is the key modulo 256, as the rest is a multiple.
            nearer = found < best[left]
            moved, stays = left[nearer], left[~nearer]
            best[moved] = found[nearer]
            at[moved] = (found[nearer] % ENTRIES).astype(np.int64)
            stretch[moved] = 0
            stretch[stays] += 1
        distance = (best - at.astype(kind)) / ENTRIES + squares if self.fits else (best - at.astype(kind)) // ENTRIES + squares
        return at, distance.astype(np.int64)

    def _walked(self, left, at, stretch, seen, best, squares, begins) -> np.ndarray:
        """Queries that still have something to compare, each at its next stretch that is not all marked."""
        while True:
            left = left[stretch[left] < len(self.edges)]
            entry, k = at[left], stretch[left]
            distance = (best[left] - entry) / ENTRIES + squares[left] if self.fits else (best[left] - entry) // ENTRIES + squares[left]
            goes_on = (self.apart[entry, begins[k]] <= 4 * distance).astype(bool)
            left, entry, k = left[goes_on], entry[goes_on], k[goes_on]
            marked = ((self.marks[entry, k] & ~seen[left]) == 0).all(axis=1)
            if not marked.any():
                return left
            stretch[left[marked]] += 1
