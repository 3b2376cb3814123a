"""Kernels against closed forms and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pulseloom.functions import kernels as K

RNG = np.random.default_rng(42)


def test_bandpass_keeps_its_band_and_stops_others():
    t = np.arange(0, 20, 1 / 256)
    inside, slow = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 0.05 * t)
    y = K.bandpass(inside + slow + 3, 256.0)
    mid = slice(512, -512)
    assert np.abs(y[mid] - inside[mid]).max() < 0.02


def test_biquad_blocks_equal_the_recursion():
    s = K.sections(*K.butterworth(2, None, 10.0, 256.0))[0]
    x, y, z1, z2 = RNG.normal(size=1000), [], 0.3, -0.2
    for v in x:
        out = s[0] * v + z1
        z1, z2 = s[1] * v - s[4] * out + z2, s[2] * v - s[5] * out
        y.append(out)
    assert np.allclose(K._biquad(x, s, np.array([0.3, -0.2])), y)


def test_butterworth_is_3_db_down_at_its_edges():
    for low, high in ((0.5, 40.0), (None, 30.0), (5.0, None)):
        z, p, k = K.butterworth(4, low, high, 256.0)
        for edge in filter(None, (low, high)):
            e = np.exp(2j * np.pi * edge / 256)
            assert math.isclose(abs(k * np.prod(e - z) / np.prod(e - p)), math.sqrt(0.5), rel_tol=1e-6)


def test_peaks_plateaus_height_and_distance():
    assert K.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0.0])).tolist() == [2, 5]
    x = np.array([0, 3, 0, 5, 0, 0, 4, 0.0])
    assert K.peaks(x, 1, 1).tolist() == [1, 3, 6]
    assert K.peaks(x, 1, 4).tolist() == [3]
    assert K.peaks(x, 3.5, 2).tolist() == [3, 6]


def test_r_peaks_of_a_spike_train():
    x = np.zeros(256 * 60)
    beats = np.arange(128, len(x) - 10, 205)
    for i, v in enumerate((0.1, 0.5, 1, 0.5, 0.1)):
        x[beats + i] += v
    found = K.r_peaks(K.bandpass(x + 0.02 * RNG.normal(size=len(x)), 256.0), 256.0)
    assert len(found) == len(beats) and np.abs(found - beats - 2).max() <= 3


@pytest.mark.parametrize("method", ["cubic", "pchip", "akima", "linear"])
def test_interpolation_reproduces_lines_and_points(method):
    t = np.cumsum(RNG.uniform(0.5, 1.5, 30))
    grid, y = K.resampled(t, 2 * t + 1, 4.0, method)
    assert np.allclose(y, 2 * grid + 1) and grid[-1] < t[-1] and math.isclose(grid[1] - grid[0], 0.25)


def test_cubic_reproduces_cubics_and_pchip_is_monotone():
    t = np.cumsum(RNG.uniform(0.5, 1.5, 12))
    f = lambda x: x**3 - 4 * x**2 + x
    grid, y = K.resampled(t, f(t))
    assert np.allclose(y, f(grid))
    _, y = K.resampled(t, np.sort(RNG.normal(size=12)), 16.0, "pchip")
    assert (np.diff(y) >= -1e-12).all()
    with pytest.raises(ValueError):
        K.resampled(t, t, 4.0, "other")


def test_welch_of_a_sine_and_parseval():
    x = np.sin(2 * np.pi * 0.25 * np.arange(4096))
    f, p = K.welch(x, 1.0, 256)
    assert f[p.argmax()] == 0.25 and math.isclose(p.sum() * (f[1] - f[0]), 0.5, rel_tol=0.01)
    assert K.welch(np.ones(100), 1.0, 50)[1].max() < 1e-20


def test_lomb_scargle_finds_a_frequency_and_keeps_the_variance():
    t = np.sort(RNG.uniform(0, 300, 400))
    f, p = K.lomb_density(t, np.sin(2 * np.pi * 0.1 * t))
    assert abs(f[p.argmax()] - 0.1) < 0.002
    assert math.isclose(p.sum() * (f[1] - f[0]), np.sin(2 * np.pi * 0.1 * t).var())


def plain_periodogram(t, y, f):
    y, w = y - y.mean(), 2 * np.pi * f[:, None]
    tau = np.arctan2(np.sin(2 * w * t).sum(1), np.cos(2 * w * t).sum(1))[:, None] / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    sines = (s * s).sum(1)  # none where all beats are half periods apart
    return 0.5 * ((c @ y) ** 2 / (c * c).sum(1) + np.where(sines > 1e-9 * len(t), (s @ y) ** 2 / sines, 0.0))


@pytest.mark.parametrize(("low", "high", "n"), [(0.003, 0.5, 1000), (0.001, 0.5, 1000), (0.01, 0.4, 37), (0.05, 0.06, 2)])
def test_fast_periodogram_equals_plain_sums(low, high, n):
    """Within 1e-11 of the largest power, for times far from 0, beats in order and out of it, and few of them."""
    for t in (np.cumsum(RNG.uniform(0.4, 1.4, 700)), 80_000 + np.cumsum(RNG.uniform(0.4, 1.4, 300)), RNG.uniform(0, 600, 50), np.arange(600.0) + 1):
        y, f = RNG.normal(0.8, 0.1, len(t)) + 0.2 * np.sin(2 * np.pi * 0.1 * t), np.linspace(low, high, n)
        want = plain_periodogram(t, y, f)
        assert np.abs(K.lomb_scargle(t, y, f) - want).max() < (1e-11 if t[0] < 1000 else 1e-9) * want.max()
    t, w = RNG.uniform(0, 100, 40), RNG.normal(size=(2, 40))
    f = 0.02 + 0.003 * np.arange(200)
    assert np.abs(K.nonuniform_sums(t, w, 0.02, 0.003, 200) - w @ np.exp(2j * np.pi * np.outer(t, f))).max() < 1e-11


def test_band_power_limits():
    f = np.linspace(0, 1, 101)
    assert math.isclose(K.band_power(f, np.ones(101), 0.2, 0.4), 0.2)
    assert K.band_power(f, np.ones(101), 0.201, 0.209) == 0.0 and K.band_power(f, -np.ones(101), 0, 1) == 0.0


def brute_counts(z, m, tol, count):
    t = [z[i : i + m] for i in range(count)]
    return sum(max(abs(a - b)) <= tol for i, a in enumerate(t) for j, b in enumerate(t) if i != j)


@pytest.mark.parametrize("version", [1, 2])
def test_sample_entropy_by_brute_force(version):
    x = np.round(RNG.normal(0.8, 0.3 if version == 1 else 0.1, 60), 2)
    z = (x - x.mean()) / x.std() if version == 1 else x
    tol, n, m = (0.2 if version == 2 else 0.2) * x.std(), len(x), 2
    if version == 1:
        t = [z[i : i + m] for i in range(n - m + 1)]
        b = sum(max(abs(t[i] - t[j])) <= tol for i in range(n - m) for j in range(n - m + 1) if i != j)
        a = brute_counts(z, m + 1, tol, n - m)
        want = -math.log(a / b * (n - m + 2) / (n - m)) if a and b else 0.0
    else:
        a, b = brute_counts(z, m + 1, tol, n - m), brute_counts(z, m, tol, n - m)
        want = -math.log(a / b) if a and b else 0.0
    assert math.isclose(K.sample_entropy(x, version=version), want, abs_tol=1e-12)
    assert K.sample_entropy(np.ones(20), version=version) == 0.0 == K.approximate_entropy(np.ones(20), version=version)


def test_approximate_entropy_is_small_for_regular_series():
    assert K.approximate_entropy(np.tile([1.0, 2.0], 60), version=2) < 0.05 < K.approximate_entropy(RNG.normal(size=200), version=2)


def test_winsorise():
    rr, t = K.winsorise(np.array([0.8, 0.8, 0.8, 0.82, 5.0]), np.arange(5.0))
    assert rr[-1] == 0.82 and math.isclose(t[-1], 3.22)
    assert K.preprocessed(np.array([0.8, 0.9]), np.array([0.8, 1.7]))[0].size == 0


def test_fourier_resampling_of_a_sine():
    t = np.arange(512) / 512
    y = K.fourier_resampled(np.sin(2 * np.pi * 5 * t), 512, 256)
    assert np.allclose(y, np.sin(2 * np.pi * 5 * np.arange(256) / 256))


def test_frequency_features_of_few_beats_are_zero():
    assert set(K.frequency_features(np.ones(5), np.arange(5.0)).values()) == {0.0}
