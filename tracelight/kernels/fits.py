"""Robust lines, penalized baselines and exponential fits."""

from __future__ import annotations

import numpy as np

#: Huber's constant and the factor from median absolute deviation to standard deviation.
HUBER, MAD = 1.345, 1.4826
FIT_POINTS: int | None = 2000


def huber_line(x: np.ndarray, y: np.ndarray, *, iterations: int = 50, tolerance: float = 1e-8) -> tuple[float, float]:
    """Slope and intercept by iterated reweighting; the scale is the residuals' median deviation."""
    design = np.column_stack([np.ones_like(x), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(iterations):
        residual = y - design @ beta
        scale = MAD * np.median(np.abs(residual - np.median(residual)))
        if scale <= np.finfo(float).eps:
            break
        size = np.abs(residual) / scale
        root = np.sqrt(np.where(size <= HUBER, 1.0, HUBER / np.maximum(size, HUBER)))
        new = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
        done = np.linalg.norm(new - beta) <= tolerance * max(1.0, float(np.linalg.norm(beta)))
        beta = new
        if done:
            break
    return float(beta[1]), float(beta[0])


def solve_banded_penalty(weights: np.ndarray, target: np.ndarray, smoothness: float) -> np.ndarray:
    """Solve (W + s D'D) z = W y for second differences D, by LDL' of the five-band matrix."""
    n = len(weights)
    diagonal = weights + smoothness * np.convolve(np.ones(n - 2), [1, 4, 1])
    first = -smoothness * np.convolve(np.ones(n - 2), [2, 2])
    second = smoothness * np.ones(n - 2)
    d, a, b = diagonal.tolist(), first.tolist(), second.tolist()
    for i in range(n - 1):
        l1 = a[i] / d[i]
        l2 = b[i] / d[i] if i < n - 2 else 0.0
        d[i + 1] -= l1 * a[i]
        if i < n - 2:
            a[i + 1] -= l1 * b[i]
            d[i + 2] -= l2 * b[i]
            b[i] = l2
        a[i] = l1
    z = (weights * target).tolist()
    for i in range(n - 1):
        z[i + 1] -= a[i] * z[i]
        if i < n - 2:
            z[i + 2] -= b[i] * z[i]
    for i in range(n):
        z[i] /= d[i]
    for i in range(n - 2, -1, -1):
        z[i] -= a[i] * z[i + 1]
        if i < n - 2:
            z[i] -= b[i] * z[i + 2]
    return np.array(z)


def asls_baseline(t: np.ndarray, y: np.ndarray, *, smoothness: float = 1e8, asymmetry: float = 0.01, iterations: int = 20, reference_rate_hz: float = 20.0) -> np.ndarray:
    """Asymmetric least squares: smooth, with weight ``asymmetry`` on what lies above. Smoothness is for a
    reference rate and grows with the fourth power of the rate."""
    if len(y) < 3:
        return np.full(len(y), np.nan)
    rate = 1 / np.median(np.diff(t))
    strength = smoothness * (rate / reference_rate_hz) ** 4
    weights = np.ones(len(y))
    z = y
    for _ in range(iterations):
        z = solve_banded_penalty(weights, y, strength)
        new = np.where(y > z, asymmetry, 1 - asymmetry)
        if np.array_equal(new, weights):
            break
        weights = new
    return z


def double_exponential_baseline(t: np.ndarray, y: np.ndarray, *, min_tau_s: float = 5.0, iterations: int = 200, points: int | None = FIT_POINTS) -> np.ndarray:
    """Offset plus two decaying exponentials under soft-L1 loss, whose quadratic zone is a tenth of the deviation, so
    that transients hardly pull the baseline up.

    Fitted to ``points`` evenly spread samples (None: all), within bounds: offset and amplitudes up to twice the 95th
    percentile, time constants from ``min_tau_s`` to ten durations. A logistic map of each parameter keeps it there."""
    if len(y) < 6:
        return np.full(len(y), np.nan)
    at = np.linspace(0, len(y) - 1, min(len(y), points or len(y)), dtype=int)
    x, v = t[at] - t[0], y[at]
    eps = float(np.finfo(float).eps)
    span, zone = max(float(t[-1] - t[0]), min_tau_s), max(0.1 * float(np.std(v)), eps)
    low = max(float(np.percentile(y, 5)), eps)
    high = max(float(np.percentile(y, 95)), low)
    rise = max(high - low, eps)
    floor = np.array([eps, 0.0, 0.0, min_tau_s, min_tau_s])
    width = np.array([2 * high, 2 * high, 2 * high, 10 * span, 10 * span]) - floor
    share = (np.array([low, 0.6 * rise, 0.4 * rise, max(min_tau_s, span / 10), span]) - floor) / width
    q = np.log((share := np.clip(share, 1e-9, 1 - 1e-9)) / (1 - share))

    def parameters(q):
        return floor + width / (1 + np.exp(-q))

    def model(p, x):
        return p[0] + p[1] * np.exp(-x / p[3]) + p[2] * np.exp(-x / p[4])

    def loss(q):
        r = (model(parameters(q), x) - v) / zone
        return float((2 * (np.sqrt(1 + r * r) - 1)).sum())

    best, damping = loss(q), 1e-2
    for _ in range(iterations):
        p = parameters(q)
        one, two = np.exp(-x / p[3]), np.exp(-x / p[4])
        slopes = np.column_stack([np.ones_like(x), one, two, p[1] * one * x / p[3] ** 2, p[2] * two * x / p[4] ** 2])
        r = (model(p, x) - v) / zone
        root = (1 + r * r) ** -0.25  # soft-L1 as reweighted least squares
        jacobian = slopes * ((p - floor) * (1 - (p - floor) / width))[None, :] / zone * root[:, None]
        a, g = jacobian.T @ jacobian, jacobian.T @ (r * root)
        new = np.clip(q - np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], -40, 40)
        trial = loss(new)
        if trial < best:
            small = best - trial < 1e-12 * max(best, 1e-12)
            q, best, damping = new, trial, max(damping / 5, 1e-12)
            if small:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return model(parameters(q), t - t[0])
