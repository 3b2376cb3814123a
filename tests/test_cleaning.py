"""Merging, filtering, cleaning and resampling by blocks, against the same in one piece."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K
from pulseloom.operators import cleaning, filters, resample
from pulseloom.sources.fixtures import beats

RNG = np.random.default_rng(7)
BEATS = "rec long, beat_idx long, rr_ms long, t_ms long"


def merged_plainly(rr, times, least=250):
    """The scan over one list: a short interval goes into the smaller neighbour, and after a merge to the left it steps back."""
    rr, times, i, any_ = list(rr), list(times), 0, False
    while i < len(rr) and len(rr) > 1:
        if rr[i] > least:
            i += 1
            continue
        to = i + 1 if i == 0 else i - 1 if i == len(rr) - 1 or rr[i - 1] <= rr[i + 1] else i + 1
        rr[to] += rr[i]
        del rr[i], times[i]
        any_ = True
        i = i if to > i else max(0, i - 1)
    return rr, [times[0] + sum(rr[:k]) for k in range(len(rr))] if any_ else times


def as_beats(spark, series):
    rows = [(rec, i + 1, int(x), int(t)) for rec, (rr, times) in enumerate(series) for i, (x, t) in enumerate(zip(rr, times, strict=True))]
    return spark.createDataFrame(rows, BEATS)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([50, 100, 120, 130, 250, 251, 300, 600, 700, 800, 900, 900]), min_size=1, max_size=40), min_size=1, max_size=12))
def test_islands_equal_one_scan(spark, lists):
    series = [(rr, 1000 + np.cumsum(rr) + 7) for rr in lists]
    got = {}
    for r in cleaning.merged_short(as_beats(spark, series)).orderBy("rec", "i").collect():
        got.setdefault(r["rec"], []).append((r["i"], r["rr_ms"], r["t_ms"]))
    for rec, (rr, times) in enumerate(series):
        want = zip(*merged_plainly(rr, [int(t) for t in times]), strict=True)
        assert got[rec] == [(i, x, t) for i, (x, t) in enumerate(want)]


@pytest.mark.parametrize("block", [40, 64, 1000, 4096])
def test_filter_by_blocks_equals_one_piece(spark, block):
    """Band-pass and high-pass, series of the least length, of one block, and of many."""
    designs = {256.0: lambda fs: K.sections(*K.butterworth(4, 0.5, 40.0, fs)), 4.0: cleaning.highpass}
    for fs, design in designs.items():
        pad = filters.padding(design(fs))
        series = [RNG.normal(size=n).cumsum() for n in (pad + 1, block, block + 1, 2 * block - 1, 2 * block, 3000)]
        rows = [(f"r{k}", i, len(x), fs, float(v)) for k, x in enumerate(series) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "name string, i long, n long, fs double, x double")
        got = filters.zero_phase(df, design, "name string", block).toPandas().sort_values(["name", "i"])
        for k, x in enumerate(series):
            y = got[got["name"] == f"r{k}"]
            want = K.filtered(x, design(fs))
            assert y["i"].tolist() == list(range(len(x)))
            assert np.allclose(y["x"], want, rtol=0, atol=1e-9 * max(1.0, np.abs(x).max())), (fs, k)


def test_zero_phase_equals_the_recursion():
    """One sample at a time, forward and backward."""
    x, sos = RNG.normal(size=300), cleaning.highpass(4.0)
    pad = filters.padding(sos)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        z, out = K.settled(sos) * y[0], []
        for u in y:
            for k, s in enumerate(sos):
                v = s[0] * u + z[2 * k]
                z[2 * k], z[2 * k + 1] = s[1] * u - s[4] * v + z[2 * k + 1], s[2] * u - s[5] * v
                u = v
            out.append(u)
        y = np.array(out)[::-1]
    assert np.allclose(K.filtered(x, sos), y[pad:-pad])


def in_one_piece(rr, times):
    rr, times = merged_plainly(rr, times)
    if len(rr) < 4:
        return np.zeros(0), np.zeros(0)
    # In milliseconds, where sums are exact: the number of grid points is a whole part.
    x, t = (v / 1000 for v in K.winsorise(np.array(rr, float), np.array(times, float)))
    return K.highpass_detrend(x - x.mean(), t), t


@pytest.mark.parametrize("block", [512, filters.BLOCK])
def test_chain_equals_one_piece_on_all_recordings(spark, block):
    d = "/root/testdata/sf0.01"
    b = beats(spark, d).orderBy("rec", "beat_idx").toPandas()
    got = cleaning.cleaned(beats(spark, d), block=block).toPandas().sort_values(["rec", "i"])
    assert set(got["rec"]) == set(b["rec"])
    for rec, rows in b.groupby("rec"):
        x, t = in_one_piece(rows["rr_ms"].tolist(), rows["t_ms"].tolist())
        mine = got[got["rec"] == rec]
        assert mine["i"].tolist() == list(range(len(x)))
        assert np.allclose(mine["t_s"], t, rtol=0, atol=1e-9) and np.allclose(mine["x"], x, rtol=0, atol=1e-9)


def test_chain_of_brief_recordings(spark):
    """Fewer than 4 intervals give nothing; a grid too short to filter loses a line; equal intervals leave nothing."""
    series = [([800, 900, 700], [800, 1700, 2400]), ([300, 400, 300, 500, 420], [300, 700, 1000, 1500, 1920]), ([800] * 100, list(range(800, 80_001, 800)))]
    got = cleaning.cleaned(as_beats(spark, series)).toPandas().sort_values(["rec", "i"])
    assert set(got["rec"]) == {1, 2} and np.abs(got[got["rec"] == 2]["x"]).max() < 1e-9
    x, t = in_one_piece(*series[1])
    assert np.allclose(got[got["rec"] == 1]["x"], x) and np.allclose(got[got["rec"] == 1]["t_s"], t)
    kept = cleaning.cleaned(as_beats(spark, series), merge=False, retime=False).toPandas().sort_values(["rec", "i"])
    x, _ = K.preprocessed(np.array(series[1][0]) / 1000, np.array(series[1][1]) / 1000)
    assert np.allclose(kept[kept["rec"] == 1]["x"], x)
    assert cleaning.cleaned(as_beats(spark, series).limit(0)).collect() == []


@pytest.mark.parametrize("method", resample.METHODS)
def test_grids_equal_one_piece(spark, sf_dir, method):
    """Whole recordings, series of two and three beats, repeated times, and flat stretches."""
    b = beats(spark, sf_dir)
    odd = [([800, 900], [800, 1700]), ([800, 900, 700], [800, 1700, 2400]), ([800, 900, 650, 900], [800, 1700, 1700, 2600]), ([700] * 9, list(range(700, 6301, 700))), ([900], [900])]
    both = b.unionByName(as_beats(spark, odd).withColumn("rec", F.col("rec") + 1000))
    got = resample.resampled(both, method=method).toPandas().sort_values(["rec", "i"])
    for rec, rows in both.orderBy("rec", "beat_idx").toPandas().groupby("rec"):
        grid, x = K.resampled(rows["t_ms"].to_numpy(float) / 1000, rows["rr_ms"].to_numpy(float) / 1000, 4.0, method)
        mine = got[got["rec"] == rec]
        assert np.allclose(mine["t_s"], grid, rtol=0, atol=1e-9) and np.allclose(mine["x"], x, rtol=0, atol=1e-9), rec
    with pytest.raises(ValueError):
        resample.resampled(b, method="other")


def test_spline_by_small_blocks_is_the_same(spark):
    t = np.cumsum(RNG.integers(200, 2000, 700))
    series = as_beats(spark, [(RNG.integers(300, 2000, 700), t)])
    k = resample.knots(series)
    whole = resample.cubic(k, 10_000).orderBy("i").toPandas()["d"].to_numpy()
    for block in (50, 128, 699):
        assert np.allclose(resample.cubic(k, block).orderBy("i").toPandas()["d"], whole, rtol=0, atol=1e-12)
