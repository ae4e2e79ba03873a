"""The floor of the estimate loses fewer pairs at the threshold than the bands do."""

from math import comb

import numpy as np

from tracelight.llm import near_dedup


def test_floor_misses_less_than_the_bands():
    n, p = near_dedup.REGISTERS, near_dedup.THRESHOLD_PERCENT / 100

    def reached(equal):
        first = np.full((1, n), 5, np.uint16)
        second = first.copy()
        second[0, equal : (n + equal) // 2] = 6
        second[0, (n + equal) // 2 :] = 4
        sizes = np.array([1000.0])
        return near_dedup.reaches(first, second, sizes, sizes)[0]

    needed = min(k for k in range(n + 1) if reached(k))
    missed = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(needed))
    bands = (1 - p**near_dedup.BAND_ROWS) ** (n // near_dedup.BAND_ROWS)
    assert missed < 0.01 * bands
