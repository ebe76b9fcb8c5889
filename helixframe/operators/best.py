"""The best of the features that overlap a row, without going through them.

What a pair is worth follows from the lengths of both and the bases they share, and grows with these. So of the
features of one length, the best are those whose starts lie in one range, and lengths are tried in the
order of what they can be worth at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Lengths of rows by lengths of features whose order is held at once.
CELLS = 4_000_000


class Features:
    """The features [a, b), which are not empty, by length and start. The position of a feature is its rank where pairs are worth the same."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.sizes, m = np.unique(b - a, return_inverse=True)
        order = np.lexsort((a, m))
        self.low, self.high = int(a.min()) - 1, int(a.max()) + 1
        self.span = self.high - self.low + 1
        self.code, self.start = (m * self.span + a - self.low)[order], a[order]
        self.rank = order
        # a feature's run of the same length and start
        new = np.concatenate([[True], self.code[1:] != self.code[:-1]])
        run, edges = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(a))
        self.first, self.beyond = edges[run], edges[run + 1]
        self.least = [order]
        while len(self.least[-1]) > 2 ** (len(self.least) - 1):
            half = 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _at(self, m: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The first place of length m whose start is pos or later."""
        return np.searchsorted(self.code, m * self.span + np.clip(pos, self.low, self.high) - self.low)

    def windows(self, s: np.ndarray, e: np.ndarray, value: Callable[..., np.ndarray]) -> tuple[np.ndarray, ...]:
        """The most that a feature is worth for each row [s, e) (-1: none overlaps), and the places of all features worth that: rows, first places, places beyond.

        value(shared, length of the row, length of the feature): not smaller for more bases shared; less than 0: not enough to count.
        """
        best = np.full(len(s), -1.0)
        found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        lengths, of = np.unique(e - s, return_inverse=True)
        each = max(1, CELLS // len(self.sizes))
        for part in range(0, len(lengths), each):
            size = lengths[part : part + each, None]
            most = value(np.minimum(size, self.sizes), size, self.sizes)
            order = np.argsort(-most, axis=1, kind="stable")
            active = np.flatnonzero((of >= part) & (of < part + each))
            for step in range(len(self.sizes)):
                row = of[active] - part
                m = order[row, step]
                open_ = most[row, m] >= np.maximum(best[active], 0)
                active, m = active[open_], m[open_]
                if not len(active):
                    break
                i, j, worth = self._of_length(m, s[active], e[active], value)
                hit = worth >= np.maximum(best[active], 0)
                found.append((active[hit], i[hit], j[hit], worth[hit]))
                best[active] = np.maximum(best[active], worth)
        row, i, j, worth = (np.concatenate(x) for x in zip(*found))
        top = worth == best[row]
        return best, row[top], i[top], j[top]

    def _of_length(self, m: np.ndarray, s: np.ndarray, e: np.ndarray, value: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of length number m: first places, places beyond, and what they are worth (-1: none overlaps)."""
        size = self.sizes[m]
        lo, hi = np.minimum(s, e - size), np.maximum(s, e - size)
        i, j = self._at(m, lo), self._at(m, hi + 1)
        whole = i < j
        # else the nearest on either side
        last = len(self.code) - 1
        shared = lambda k, ok: np.where(ok, np.minimum(e, self.start[k] + size) - np.maximum(s, self.start[k]), 0)
        before, after = np.maximum(i - 1, 0), np.minimum(j, last)
        left = shared(before, (i > 0) & (self.code[before] // self.span == m))
        right = shared(after, (j <= last) & (self.code[after] // self.span == m))
        most = np.where(whole, np.minimum(e - s, size), np.maximum(left, right))
        i, j = np.where(whole | (left < most), i, self.first[before]), np.where(whole | (right < most), j, self.beyond[after])
        any_ = most > 0
        worth = np.where(any_, value(np.maximum(most, 1), e - s, size), -1.0)
        # fewer bases may be worth as much, as values are rounded
        more = np.flatnonzero((most > 1) & (worth >= 0) & (value(np.maximum(most - 1, 1), e - s, size) == worth))
        if len(more):
            x, y, n, w, least, upto = s[more], e[more], size[more], worth[more], np.ones(len(more), np.int64), most[more] - 1
            while (least < upto).any():
                half = (least + upto) // 2
                enough = value(half, y - x, n) == w
                least, upto = np.where(enough, least, half + 1), np.where(enough, half, upto)
            i[more], j[more] = self._at(m[more], x - n + least), self._at(m[more], y - least + 1)
        return i, j, worth

    def best(self, s: np.ndarray, e: np.ndarray, value: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The most that a feature is worth for each row, and of those worth that the one of the smallest rank (-1: none overlaps)."""
        worth, row, i, j = self.windows(s, e, value)
        out = np.full(len(s), len(self.rank))
        deep = np.frexp(j - i)[1] - 1  # two stretches of 2^k cover a window
        for k in np.unique(deep):
            own = deep == k
            np.minimum.at(out, row[own], np.minimum(self.least[k][i[own]], self.least[k][j[own] - 2**k]))
        return worth, np.where(out < len(self.rank), out, -1)


def rounded(digits: int, value: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """A value in whole units of its last digit."""
    return lambda *x: np.floor(value(*x) * 10.0**digits + 0.5)
