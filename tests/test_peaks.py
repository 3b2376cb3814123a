"""R-peaks by blocks against the same in one piece."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.functions import kernels as K
from pulseloom.operators import filters, peaks, signal

RNG = np.random.default_rng(11)


def ecg(n, noise=0.1):
    """Spikes each 0.8 s in noise, at 256 Hz."""
    x = noise * RNG.normal(size=n)
    for at in range(100, n - 5, 205):
        x[at : at + 5] += (0.1, 0.5, 1, 0.5, 0.1)
    return x.astype(np.float32)


def pieces(spark, signals, sizes):
    rows = []
    for name, x in signals.items():
        at = 0
        while at < len(x):
            size = int(sizes[len(rows) % len(sizes)])
            rows.append((name, at, x[at : at + size].tolist()))
            at += size
    return spark.createDataFrame(rows, "recording_id string, start_sample long, samples array<float>").repartition(5)


def found(df):
    out = {}
    for r in df.orderBy("recording_id", "beat_idx").collect():
        out.setdefault(r["recording_id"], []).append((r["beat_idx"], r["sample"]))
    return out


@pytest.mark.parametrize("block", [64, 1000, 4096, filters.BLOCK])
def test_beats_are_the_same_at_any_block_size(spark, block):
    signals = {"long": ecg(20_000), "clear": ecg(4000, 0.01), "noisy": ecg(9000, 2.0), "short": ecg(300), "flat": np.full(5000, 0.25, np.float32), "brief": ecg(20)}
    got = found(signal.r_peaks(pieces(spark, signals, [256, 700, 31, 1]), block=block))
    for name in ("long", "noisy", "short"):
        want = K.r_peaks(K.bandpass(signals[name].astype(float), 256.0), 256.0)
        assert got[name] == list(enumerate(want.tolist())), name
    assert "flat" not in got and "brief" not in got and len(got["clear"]) == len(range(100, 4000 - 5, 205))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=60), st.integers(3, 20))
def test_plateaus_across_blocks(spark, values, block):
    """All maxima of a signal of few levels, whose plateaus may span several blocks."""
    x = np.array(values, float)
    df = spark.createDataFrame([(1, 0, len(x), 1.0, x.tolist())], "rec long, i long, n long, fs double, x array<double>")
    at, facts = peaks.maxima(filters.cut(df, "rec", block), "rec long")
    want = K.local_maxima(x)
    assert sorted((r["pos"], r["height"]) for r in at.collect()) == [(int(i), float(x[i])) for i in want]
    r = facts.first()
    assert np.isclose(r["mean"], x.mean()) and np.isclose(r["sd"], x.std(), atol=1e-7)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 4)), min_size=1, max_size=60, unique_by=lambda p: p[0]))
def test_chains_settle_alone(spark, points):
    points = sorted(points)
    at = peaks.apart(spark.createDataFrame([(1, p, float(h)) for p, h in points], "rec long, pos long, height double"), "rec", 20)
    want = K.highest_apart(np.array([p for p, _ in points]), np.array([h for _, h in points], float), 20)
    assert sorted(r["pos"] for r in at.collect()) == want.tolist()


def test_signals_at_another_rate(spark):
    x = np.repeat(ecg(6000), 2)
    rows = spark.createDataFrame([("twice", 0, x.tolist(), 512.0), ("same", 0, ecg(6000).tolist(), 256.0)], "recording_id string, start_sample long, samples array<float>, fs double")
    got = found(signal.r_peaks(rows))
    want = K.r_peaks(K.bandpass(K.fourier_resampled(x.astype(float), 512.0, 256.0), 256.0), 256.0)
    assert got["twice"] == list(enumerate(want.tolist())) and len(got["same"]) > 20
