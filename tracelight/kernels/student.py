"""Student's t from the incomplete beta function."""

from __future__ import annotations

from math import exp, lgamma, log, log1p, sqrt


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized, by Lentz's continued fraction on the side where it converges."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or 1e-300)
        c = 1 + step / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t >= 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """By bisection on the distribution function."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1")
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def noncentral_power(delta: float, df: float, alpha: float = 0.05, steps: int = 4000) -> float:
    """P(|T| > critical) for a noncentral t, by Simpson's rule over the scale."""
    critical = t_quantile(1 - alpha / 2, df)
    from math import erf

    phi = lambda z: 0.5 * (1 + erf(z / sqrt(2)))
    # the scale s = sqrt(chi2 / df) has density f; T = (z + delta) / s
    log_norm = log(2) + (df / 2) * log(df / 2) - lgamma(df / 2)
    top = 1 + 12 / sqrt(df)
    h = top / steps
    total = 0.0
    for i in range(1, steps):
        s = i * h
        density = exp(log_norm + (df - 1) * log(s) - df * s * s / 2)
        tail = 1 - phi(critical * s - delta) + phi(-critical * s - delta)
        total += (4 if i % 2 else 2) * density * tail
    return total * h / 3
