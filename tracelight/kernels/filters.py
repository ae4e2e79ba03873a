"""Butterworth low-pass filters run forwards and backwards."""

from __future__ import annotations

import numpy as np


def butterworth_sections(cutoff_hz: float, rate_hz: float, order: int) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) by the bilinear transform of the analog prototype's pole pairs."""
    if not 0 < cutoff_hz < rate_hz / 2:
        raise ValueError("the cutoff lies between 0 and half the sampling rate")
    w = np.tan(np.pi * cutoff_hz / rate_hz)
    sections = []
    for k in range(order // 2):
        damping = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        norm = 1 + damping * w + w * w
        sections.append([w * w / norm, 2 * w * w / norm, w * w / norm, 2 * (w * w - 1) / norm, (1 - damping * w + w * w) / norm])
    if order % 2:
        sections.append([w / (1 + w), w / (1 + w), 0.0, (w - 1) / (1 + w), 0.0])
    return np.array(sections)


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter with each section's state set to that of a constant first sample."""
    out = x.astype(float).tolist()
    for b0, b1, b2, a1, a2 in sections.tolist():
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        first = out[0]
        z1, z2 = (gain - b0) * first, (b2 - a2 * gain) * first
        for i, v in enumerate(out):
            y = b0 * v + z1
            z1 = b1 * v - a1 * y + z2
            z2 = b2 * v - a2 * y
            out[i] = y
    return np.array(out)


def zero_phase_lowpass(t: np.ndarray, x: np.ndarray, cutoff_hz: float, order: int = 4) -> np.ndarray:
    """Forward and backward, over odd extensions at both ends; missing where the run is no longer than them."""
    if len(x) < 2:
        return np.full(len(x), np.nan)
    sections = butterworth_sections(cutoff_hz, 1 / float(np.median(np.diff(t))), order)
    pad = 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 4] == 0).sum())))
    if len(x) <= pad:
        return np.full(len(x), np.nan)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    wide = run_sections(sections, run_sections(sections, wide)[::-1])[::-1]
    return wide[pad : pad + len(x)]
