"""Exact byte-pair merging of many words at once, a matrix row for each word."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40


class Pairs:
    """Which neighbouring symbols merge: (left, right) to a rank (lowest first) and a new symbol."""

    def __init__(self, left, right, rank, new, symbols: int):
        key = np.asarray(left, np.int64) * symbols + np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.symbols, self.key = symbols, key[order]
        self.rank, self.new = np.asarray(rank, np.int64)[order], np.asarray(new, np.int64)[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.full(left.shape, NONE), np.zeros(left.shape, np.int64)
        key = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), self.new[at]


def merge_rows(sym: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after merging, and how many each row has. All rows start equally long.

    Each round merges, in every row, the leftmost pair of lowest rank, which is what a
    priority queue over (rank, position) does.
    """
    rows, width = sym.shape
    out, length = sym.copy(), np.full(rows, width)
    live = np.arange(rows)
    rank, new = pairs.find(sym[:, :-1], sym[:, 1:])
    while width > 1 and len(live):
        at = rank.argmin(axis=1)
        each = np.arange(len(live))
        on = rank[each, at] < NONE
        if not on.all():
            stop = live[~on]
            out[stop, :width], length[stop] = sym[~on], width
            live, sym, rank, new, at = live[on], sym[on], rank[on], new[on], at[on]
            each = np.arange(len(live))
            if not len(live):
                break
        sym[each, at] = new[each, at]
        width -= 1
        place = np.arange(width)
        sym = np.take_along_axis(sym, place + (place > at[:, None]), axis=1)
        if width == 1:
            break
        place = place[:-1]
        move = place + (place >= at[:, None])
        rank, new = np.take_along_axis(rank, move, axis=1), np.take_along_axis(new, move, axis=1)
        for rows_, col in ((at > 0, at - 1), (at < width - 1, at)):
            r, c = each[rows_], col[rows_]
            rank[r, c], new[r, c] = pairs.find(sym[r, c], sym[r, c + 1])
    if len(live):
        out[live, :width], length[live] = sym, width
    return out, length
