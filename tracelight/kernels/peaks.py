"""Local maxima, greedy distance and prominence."""

from __future__ import annotations

import numpy as np


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles of plateaus that are higher than both sides; edges are no maxima."""
    if len(x) < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.diff(x))
    if len(change) < 2:
        return np.zeros(0, int)
    left, right = change[:-1] + 1, change[1:]  # plateau between two changes
    rise = x[left] > x[left - 1]
    fall = x[right + 1] < x[right]
    return ((left + right) // 2)[rise & fall]


def keep_distant(peaks: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Peaks left when, from the highest down, each drops the others nearer than ``distance`` samples."""
    if distance <= 1 or not len(peaks):
        return peaks
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(peaks) and abs(peaks[j] - peaks[i]) < distance:
                    keep[j] = False
                    j += step
    return peaks[keep]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height above the higher of the two valleys that part a peak from higher ground or the edge."""
    out = np.empty(len(peaks))
    for k, p in enumerate(peaks):
        higher_left, higher_right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        left = higher_left[-1] + 1 if len(higher_left) else 0
        right = p + 1 + higher_right[0] if len(higher_right) else len(x)
        out[k] = x[p] - max(x[left : p + 1].min(), x[p:right].min())
    return out


def find_peaks(x: np.ndarray, *, height: float | None = None, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Maxima that pass height, then distance, then prominence."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    peaks = keep_distant(peaks, x[peaks], distance)
    if prominence is not None:
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks
