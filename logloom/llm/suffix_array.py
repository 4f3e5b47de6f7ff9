"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations over one shard.

Induced sorting goes bucket by bucket (a bucket holds the suffixes of one first symbol); all suffixes that a
bucket induces are placed at once. The leftmost-smaller (LMS) substrings are named in their induced order, and
the string of names is sorted recursively. Where names have become so many that buckets hold next to nothing,
the string of names, by then a small part of the input, is sorted by doubling ranks instead.
"""

from __future__ import annotations

import numpy as np

#: Beyond so many symbols the recursion ends in rank doubling.
SYMBOLS = 4096


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S type); the last symbol, the sentinel, is."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        step = np.sign(s[1:] - s[:-1])
        ends = np.flatnonzero(step)  # the last place of each run of equal symbols but the last run
        own = np.append(step[ends] > 0, True)
        out[:] = np.repeat(own, np.diff(np.concatenate([[-1], ends, [n - 1]])))
    return out


class _Buckets:
    def __init__(self, s: np.ndarray, small: np.ndarray, symbols: int):
        self.s, self.small = s, small
        self.count = np.bincount(s, minlength=symbols)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count

    def _grouped(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``at`` grouped by symbol without changing the order inside a group; symbols, their counts, ranks in the group."""
        symbol = self.s[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        size = np.diff(np.append(first, len(at)))
        return at, symbol[first], size, np.arange(len(at)) - np.repeat(first, size)

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array that sorted LMS suffixes induce (or the order by LMS substrings, from unsorted ones)."""
        out = np.full(len(self.s), -1, np.int64)
        put = np.zeros(len(self.count), np.int64)
        at, symbol, size, rank = self._grouped(lms)
        own = np.repeat(self.end[symbol] - size, size) + rank
        out[own] = at
        held = np.zeros(len(self.count), np.int64)
        held[symbol] = size
        self._left(out, put, held)
        self._right(out, put)
        return out

    def _left(self, out: np.ndarray, put: np.ndarray, held: np.ndarray) -> None:
        for c in np.flatnonzero(self.count):
            done = self.start[c]
            while done < self.start[c] + put[c]:
                upto = self.start[c] + put[c]
                self._append(out, put, out[done:upto])
                done = upto
            if held[c]:
                self._append(out, put, out[self.end[c] - held[c]:self.end[c]])

    def _append(self, out: np.ndarray, put: np.ndarray, suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~self.small[before]]
        if len(before):
            at, symbol, size, rank = self._grouped(before)
            out[np.repeat(self.start[symbol] + put[symbol], size) + rank] = at
            put[symbol] += size

    def _right(self, out: np.ndarray, large: np.ndarray) -> None:
        """S suffixes from the right: they come before the larger suffix they precede, at the end of their bucket."""
        put = np.zeros(len(self.count), np.int64)
        for c in np.flatnonzero(self.count)[::-1]:
            done = self.end[c]
            while done > self.end[c] - put[c]:
                upto = self.end[c] - put[c]
                self._prepend(out, put, out[upto:done][::-1])
                done = upto
            if large[c]:
                self._prepend(out, put, out[self.start[c]:self.start[c] + large[c]][::-1])
        if len(self.s):
            out[0] = len(self.s) - 1

    def _prepend(self, out: np.ndarray, put: np.ndarray, suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[self.small[before]]
        if len(before):
            at, symbol, size, rank = self._grouped(before)
            out[np.repeat(self.end[symbol] - put[symbol], size) - 1 - rank] = at
            put[symbol] += size


def _by_doubling(s: np.ndarray) -> np.ndarray:
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings: equal for equal substrings, in the order ``order`` (places in ``lms``)."""
    size = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    differ = size[a] != size[b]
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        same = s[lms[a[live]] + k] == s[lms[b[live]] + k]
        differ[live[~same]] = True
        live = live[same]
        k += 1
        live = live[size[a[live]] > k]
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(differ)])
    return names


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The sorted suffixes of ``s``, whose last symbol 0 occurs nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    if symbols > SYMBOLS:
        return _by_doubling(s)
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    buckets = _Buckets(s, small, symbols)
    place = np.full(len(s), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = place[buckets.induce(lms)]
    order = order[order >= 0]
    names = _names(s, lms, order)
    count = int(names[order[-1]]) + 1
    if count < len(lms):
        order = suffix_array(names, count)
    return buckets.induce(lms[order])


def common_prefixes(data: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix of ``data`` the length it shares with the one before it in ``array`` (0 for the first).

    Permuted order makes most values follow from their left neighbour, one less. Only those whose preceding
    bytes differ (the irreducible ones) are compared, eight bytes at a time; a running maximum gives the rest.
    ``array`` is over ``data`` and one sentinel after it.
    """
    n = len(data)
    before = np.full(n + 1, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    before = before[:n]
    alone = (before < 0) | (before >= n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & ~alone[1:] & (data[np.maximum(before[1:], 1) - 1] == data[:-1]) & ~alone[:-1]
    live = np.flatnonzero(~follows & ~alone)
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + 1,), (1,))
    a, b = live.copy(), before[live].copy()
    while len(live):
        differ = eights[np.minimum(a, n)] ^ eights[np.minimum(b, n)]
        same = differ == 0
        lowest = differ & (~differ + np.uint64(1))
        # the number of whole equal bytes below the lowest differing bit
        equal = np.where(same, 8, np.searchsorted(_POWERS, lowest, "right") // 8)
        shared[live] += np.minimum(equal, n - np.maximum(a, b)).clip(0)
        more = same & (np.maximum(a, b) + 8 < n)
        live, a, b = live[more], a[more] + 8, b[more] + 8
    reach = np.maximum.accumulate(np.where(follows, 0, shared + at))
    return np.where(alone, 0, np.maximum(reach - at, 0))


_POWERS = np.array([1 << k for k in range(1, 64)], np.uint64)
