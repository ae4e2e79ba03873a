"""Order statistics of many windows of one array, without going through the windows."""

from __future__ import annotations

import numpy as np


class Windows:
    """A wavelet matrix over the ranks of ``x``: the k-th smallest of any ``x[i:j]`` in one step per bit of a rank."""

    def __init__(self, x: np.ndarray):
        self.values, rank = np.unique(x, return_inverse=True)
        self.levels = []
        for level in range(max(len(self.values) - 1, 1).bit_length() - 1, -1, -1):
            bit = (rank >> level) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32)
            self.levels.append((level, zeros))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def kth(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """``sorted(x[i:j])[k]``, windows by windows; ``0 <= k < j - i``."""
        i, j, k, found = i.copy(), j.copy(), k.copy(), np.zeros(len(i), np.int64)
        for level, zeros in self.levels:
            a, b = zeros[i], zeros[j]
            up = k >= b - a
            k -= np.where(up, b - a, 0)
            i, j = np.where(up, zeros[-1] + i - a, a), np.where(up, zeros[-1] + j - b, b)
            found |= up.astype(np.int64) << level
        return self.values[found]

    def median(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return 0.5 * self.kth(i, j, (j - i - 1) // 2) + 0.5 * self.kth(i, j, (j - i) // 2)

    def median_deviation(self, i: np.ndarray, j: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Median of ``abs(x[i:j] - centre)``: the nearest values to a centre are neighbours in order, found by halving."""
        n = j - i
        size = (n - 1) // 2 + 1  # the lower middle deviation is the size-th smallest
        low, high = np.zeros_like(n), n - size
        while (open_ := low < high).any():
            p = np.flatnonzero(open_)
            mid = (low[p] + high[p]) // 2
            right = centre[p] - self.kth(i[p], j[p], mid) > self.kth(i[p], j[p], mid + size[p]) - centre[p]
            low[p], high[p] = np.where(right, mid + 1, low[p]), np.where(right, high[p], mid)
        away = lambda k: np.abs(self.kth(i, j, k) - centre)
        lower = np.maximum(away(low), away(low + size - 1))
        left = np.where(low > 0, away(np.maximum(low - 1, 0)), np.inf)
        right = np.where(low + size < n, away(np.minimum(low + size, n - 1)), np.inf)
        return np.where(n % 2 == 1, lower, 0.5 * lower + 0.5 * np.where(n % 2 == 1, lower, np.minimum(left, right)))


def first_stable(x: np.ndarray, i: np.ndarray, j: np.ndarray, centre: np.ndarray, reach: np.ndarray, stable: int, block: int = 64) -> np.ndarray:
    """First place of each ``x[i:j]`` from which ``stable`` values in a row lie within ``reach`` of the centre; -1 without one.

    Places of a block whose lowest top or highest bottom is out of reach are passed over together."""
    out = np.full(len(i), -1, np.int64)
    last = len(x) - stable
    if last < 0:
        return out
    runs = np.lib.stride_tricks.sliding_window_view(x, stable)
    top, bottom = runs.max(axis=1), runs.min(axis=1)
    starts = np.arange(0, last + 1, block)
    lowest_top, highest_bottom = np.minimum.reduceat(top, starts), np.maximum.reduceat(bottom, starts)
    at, todo = i.astype(np.int64).copy(), np.flatnonzero(i + stable <= j)
    while len(todo):
        p = at[todo]
        ok = np.maximum(np.abs(top[p] - centre[todo]), np.abs(bottom[p] - centre[todo])) <= reach[todo]
        out[todo[ok]] = p[ok]
        todo = todo[~ok]
        p = at[todo]
        b = p // block
        hopeless = (p % block == 0) & ((lowest_top[b] - centre[todo] > reach[todo]) | (centre[todo] - highest_bottom[b] > reach[todo]))
        at[todo] += np.where(hopeless, block, 1)
        todo = todo[at[todo] + stable <= j[todo]]
    return out
