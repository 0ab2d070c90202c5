"""A run-length index of byte strings: run-compressed Burrows-Wheeler transform with sampled run ends.

Rows of the transform are suffixes in order. Only runs of equal symbols are kept: where they start, their
symbol, how many rows of that symbol lie before them, and the text position of the first and the last
suffix of each. Strings are matched from right to left, all of them a step at a time. While the symbol
at the current row is the one wanted, one step of the last-to-first mapping follows it; else the search
jumps to the nearest run of that symbol above or below, whichever suffix agrees longer with the current
one. That gives the matching statistics: for each place of a string, how far it agrees with the indexed
text and a row where it does.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Symbols of nine bits, bytes raised by one over the end mark 0; seven fit a sort key.
_BITS, _PACKED = 9, 7


def suffix_order(text: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array by prefix doubling, and for each wanted length, at least seven, the ranks of the suffixes by that many symbols."""
    n = len(text)
    padded = np.zeros(n + _PACKED, np.int64)
    padded[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(_PACKED):
        key = (key << _BITS) | padded[k : k + n]
    order, rank = _ranked(key)
    size, wanted = _PACKED, {}
    # Ranks that a wanted length is made of.
    ranks = {size: rank}
    # An end mark past the text is lower than all, so the last suffixes come out right.
    while rank[order[-1]] < n - 1:
        order, rank = _ranked(_paired(rank, size, n))
        size *= 2
        if size <= max(lengths, default=0):
            ranks[size] = rank
    for length in lengths:
        below = max(s for s in ranks if s <= length)
        gap = length - below
        # More than twice as long as any rank: all suffixes differ before.
        wanted[length] = rank if gap > below else _ranked(_paired(ranks[below], gap, n))[1] if gap else ranks[below]
    return order, wanted


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    placed = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], placed[1:] != placed[:-1])))
    return order, rank


def _paired(rank: np.ndarray, gap: int, n: int) -> np.ndarray:
    second = np.zeros(n, np.int64)
    if gap < n:
        second[: n - gap] = rank[gap:] + 1
    return rank * (n + 1) + second


class RunIndex:
    """Index of ``strings``, an array of rows padded with anything beyond ``lengths``."""

    def __init__(self, strings: np.ndarray, lengths: np.ndarray, match: int):
        self.match, self.width = match, strings.shape[1]
        inside = np.arange(self.width + 1)[None, :] <= lengths[:, None]
        marked = np.zeros((len(strings), self.width + 1), np.int16)
        marked[:, : self.width] = strings
        marked[:, : self.width] += 1
        marked[np.arange(len(strings)), lengths] = 0
        self.text = marked[inside]
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        n = len(self.text)
        order, ranks = suffix_order(self.text, (match,))
        self.long_rank = ranks[match]
        last = self.text[order - 1]  # the symbol before position 0 is the final end mark
        heads = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.start, self.symbol = heads, last[heads].astype(np.int64)
        sizes = np.diff(np.concatenate((heads, [n])))
        self.first, self.last = order[heads], order[heads + sizes - 1]
        by_symbol = np.argsort(self.symbol, kind="stable")
        grown = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        self.before = np.empty(len(heads), np.int64)
        # Rows of all lower symbols, and of this symbol in earlier runs.
        self.before[by_symbol] = grown
        self.run_key = self.symbol[by_symbol] * len(heads) + by_symbol
        self.by_symbol = by_symbol
        self.padded = np.concatenate((self.text, np.zeros(self.width + 1, np.int16)))

    def long_groups(self, value: np.ndarray) -> np.ndarray:
        """Smallest ``value`` (one per string) among suffixes that share their first ``match`` symbols, by text position."""
        least = np.full(int(self.long_rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.long_rank, value[self.owner])
        return least[self.long_rank]

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, up to the width."""
        views = sliding_window_view(self.padded, self.width)
        differ = (views[a] != views[b]) | (views[a] == 0)
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)

    def statistics(self, strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: (length, text position) arrays of the shape of ``strings``; length 0 beyond a string."""
        runs, n = len(self.start), len(self.text)
        size = np.zeros(strings.shape, np.int16)
        place = np.zeros(strings.shape, np.int64)
        row = np.zeros(len(strings), np.int64)
        # Row 0 is the suffix at the last end mark.
        at = np.full(len(strings), n - 1, np.int64)
        length = np.zeros(len(strings), np.int64)
        for column in range(self.width - 1, -1, -1):
            live = np.flatnonzero(column < lengths)
            if not len(live):
                continue
            wanted = strings[live, column].astype(np.int64) + 1
            run = np.searchsorted(self.start, row[live], "right") - 1
            to, pos, got = row[live].copy(), at[live].copy(), length[live].copy()
            off = np.flatnonzero(self.symbol[run] != wanted)
            if len(off):
                nr = np.searchsorted(self.run_key, wanted[off] * runs + run[off])
                above, below = nr - 1, nr
                has_above = (above >= 0) & (self.symbol[self.by_symbol[np.maximum(above, 0)]] == wanted[off])
                has_below = (below < runs) & (self.symbol[self.by_symbol[np.minimum(below, runs - 1)]] == wanted[off])
                up, down = self.by_symbol[np.maximum(above, 0)], self.by_symbol[np.minimum(below, runs - 1)]
                up_pos, down_pos = self.last[up], self.first[down]
                agree_up = np.where(has_above, np.minimum(self._agree(pos[off], up_pos), got[off]), -1)
                agree_down = np.where(has_below, np.minimum(self._agree(pos[off], down_pos), got[off]), -1)
                upper = agree_up >= agree_down
                ends = np.concatenate((self.start[1:], [n])) - 1
                to[off] = np.where(upper, ends[up], self.start[down])
                pos[off] = np.where(upper, up_pos, down_pos)
                got[off] = np.maximum(agree_up, agree_down)
                run[off] = np.where(upper, up, down)
            found = got >= 0
            step = self.before[run] + to - self.start[run]
            row[live] = np.where(found, step, 0)
            at[live] = np.where(found, (pos - 1) % n, n - 1)
            length[live] = np.where(found, got + 1, 0)
            size[live, column] = length[live]
            place[live, column] = at[live]
        return size, place
