"""Numerics against closed forms."""

import math

import numpy as np
import pytest

from tracelight.kernels import filters, fits, peaks, student
from tracelight.operators import encoding, inference
from tracelight.operators.association import assess_mixing, kinetic_kernel


def test_student_quantiles_and_tails():
    assert student.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert student.t_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-6)
    assert student.t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-12)
    assert student.t_two_sided(2.0, 1e7) == pytest.approx(0.0455, abs=1e-4)
    with pytest.raises(ValueError):
        student.t_quantile(1.0, 3)


def test_power_lies_near_the_published_simulation():
    for n, want in ((6, 0.2287), (30, 0.8616)):
        assert student.noncentral_power(0.8 / math.sqrt(2 / n), 2 * n - 2) == pytest.approx(want, abs=0.015)


def test_huber_line_resists_outliers():
    x = np.linspace(0, 10, 200)
    y = 3 + 2 * x
    y[::20] += 500
    slope, intercept = fits.huber_line(x, y)
    assert slope == pytest.approx(2, abs=1e-3) and intercept == pytest.approx(3, abs=1e-2)
    assert fits.huber_line(x, 3 + 2 * x) == pytest.approx((2, 3))


def test_banded_solver_equals_a_dense_one():
    rng = np.random.default_rng(0)
    w, y, s = rng.uniform(0.1, 1, 12), rng.normal(size=12), 7.0
    d = np.diff(np.eye(12), n=2, axis=0)
    assert np.allclose(fits.solve_banded_penalty(w, y, s), np.linalg.solve(np.diag(w) + s * d.T @ d, w * y))


def test_asls_follows_a_drift_under_transients():
    t = np.arange(1200) / 20
    drift = 5 - 0.02 * t
    x = drift + np.where((np.arange(1200) % 300) < 20, 1.0, 0.0)
    assert np.median(np.abs(fits.asls_baseline(t, x, smoothness=1e6) - drift)) < 0.02
    assert np.isnan(fits.asls_baseline(t[:2], x[:2])).all()


def test_double_exponential_recovers_bleaching():
    t = np.arange(0, 300, 0.05)
    truth = 2 + 1.5 * np.exp(-t / 20) + 0.7 * np.exp(-t / 200)
    found = fits.double_exponential_baseline(t, truth)
    assert np.sqrt(np.mean((found / truth - 1) ** 2)) < 0.002


def test_lowpass_keeps_slow_and_drops_fast():
    t = np.arange(2000) / 100
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 30 * t)
    out = filters.zero_phase_lowpass(t, slow + fast, 3.0, 4)
    assert np.abs(out - slow)[100:-100].max() < 0.01
    assert np.allclose(filters.zero_phase_lowpass(t, np.full(2000, 4.2), 3.0, 3), 4.2)
    assert np.isnan(filters.zero_phase_lowpass(t[:8], slow[:8], 3.0)).all()
    with pytest.raises(ValueError):
        filters.butterworth_sections(60, 100, 2)


def test_butterworth_halves_power_at_the_cutoff():
    for order in (1, 2, 3, 4, 5):
        z = np.exp(-2j * np.pi * 10 / 100)
        gain = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in filters.butterworth_sections(10, 100, order)])
        assert abs(gain) == pytest.approx(math.sqrt(0.5), abs=1e-9)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 1.5, 0.5, 3, 3])
    assert peaks.local_maxima(x).tolist() == [1, 4, 7]
    assert peaks.find_peaks(x, distance=4).tolist() == [4]
    assert peaks.find_peaks(x, height=1.2).tolist() == [4, 7]
    assert peaks.prominences(x, np.array([1, 4, 7])).tolist() == [1, 2, 1.0]
    assert peaks.find_peaks(x, prominence=1.5).tolist() == [4]
    assert len(peaks.local_maxima(np.ones(5))) == 0


def test_resampling_inference():
    rng = np.random.default_rng(1)
    values = rng.normal(1, 1, 10)
    assert inference.sign_flip_p(np.array([1.0, 1, 1])) == pytest.approx((1 + 2) / 9)
    assert inference.label_shuffle_p(np.array([10.0, 11]), np.array([0.0, 1])) == pytest.approx((1 + 2) / 7)
    for method in ("percentile", "basic", "bca"):
        low, high = inference.bootstrap_units(values, method=method)
        assert low < values.mean() < high
    _, _, critical = inference.simultaneous_band(rng.normal(size=(8, 30)), draws=300)
    assert critical >= student.t_quantile(0.975, 7)
    assert inference.recommend(5, assigned_to_unit=False, randomized=True) == "exact_sign_flip"
    assert inference.recommend(25, assigned_to_unit=False, randomized=True) == "monte_carlo_sign_flip"
    assert inference.recommend(5, assigned_to_unit=True, randomized=False) == "welch_t"


def test_ridge_from_sums_equals_ridge_on_rows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    full = np.column_stack([x, np.ones(60), y])
    coef, intercept = encoding.fit_ridge(full.T @ full, 2.0)
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ (y - y.mean()))
    assert np.allclose(coef, want)
    fit = x @ coef + intercept
    assert encoding.r_squared(full.T @ full, coef, intercept) == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert encoding.group_folds({"a": 5, "b": 3, "c": 3, "d": 1}, 2) == [["a", "d"], ["b", "c"]]
    basis = encoding.raised_cosines(9, 4)
    assert np.allclose(basis.sum(axis=1), 1) and (basis >= 0).all()


def test_kernels_and_mixing_designs():
    k = kinetic_kernel(0.1, 0.5, 0.05)
    assert k.sum() == pytest.approx(1) and k[0] == 0 and (k >= 0).all()
    with pytest.raises(ValueError):
        kinetic_kernel(1.0, 0.5, 0.05)
    good = assess_mixing(np.array([[1, 0.2], [0.3, 1], [0.5, 0.5]]))
    assert good["identifiable"] and good["solvable_without"] == [True, True, True]
    assert not assess_mixing(np.array([[1.0, 2], [2, 4]]))["identifiable"]
