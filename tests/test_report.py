"""The statistical report against plain windows, and the published figures of its tests."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K
from pulseloom.operators import stats
from pulseloom.plans import report

#: U and two-sided p of 50 and 50 windows, as published; extremes have a few ties there, which lower p by up to 0.3 %.
PUBLISHED = {
    "ApEn_5": (1363.0, 4.3801e-01), "RMSSD_3": (2004.0, 2.0528e-07), "RRMax_3": (1137.0, 4.3796e-01), "RRMean_3": (1175.0, 6.0754e-01), "RRMin_3": (662.0, 5.1072e-05),
    "RRVar_3": (1803.0, 1.3962e-04), "SD1_5": (2031.0, 7.4227e-08), "SD1toSD2_5": (1345.0, 5.1475e-01), "SD2_5": (1785.0, 2.2893e-04), "SDNN_3": (1803.0, 1.3962e-04),
    "SDSD_3": (2003.0, 2.1302e-07), "SampEn_3": (1394.0, 3.2253e-01),
}


def test_p_of_all_published_figures(spark):
    """Groups of 50 and 50 that have just the published U give the published p."""
    rows = []
    for name, (u, _) in PUBLISHED.items():
        # Of 100 ranks, the lowest 50 for group a have U = 0; moving one up by k raises it by k.
        a, left = list(range(50)), int(u)
        for i in range(49, -1, -1):
            step = min(50, left)
            a[i] += step
            left -= step
        rows += [(f"{'ab'[k not in set(a)]}{k}", "a" if k in set(a) else "b", name, float(k)) for k in range(100)]
    long = spark.createDataFrame(rows, "sample_id string, grp string, feature string, value double")
    got = {r["feature"]: r for r in stats.mann_whitney(long, "a", "b").collect()}
    for name, (u, p) in PUBLISHED.items():
        assert got[name]["u"] == u and math.isclose(got[name]["p"], p, rel_tol=3e-3), (name, got[name]["p"])


def beats(spark, rec, n, seed, short=0):
    rng = np.random.default_rng(seed)
    rr = rng.integers(600, 1100, n)
    rr[rng.choice(n, short, replace=False)] = 210
    t = np.cumsum(rr)
    return [(rec, i + 1, int(x), int(v)) for i, (x, v) in enumerate(zip(rr, t, strict=True))]


@pytest.fixture(scope="module")
def made(spark):
    rows = beats(spark, 1, 9000, 1, 40) + beats(spark, 2, 9000, 2) + beats(spark, 3, 9000, 3) + beats(spark, 4, 80, 4) + beats(spark, 5, 2000, 5)
    b = spark.createDataFrame(rows, "rec long, beat_idx long, rr_ms long, t_ms long")
    # 3: no control period; 4: too few beats; 5: data ends long before the onset.
    onsets = spark.createDataFrame([(1, 6200), (2, 5100), (3, 4000), (4, 60), (5, 5000)], "rec long, onset long")
    return b, onsets


def test_features_equal_plain_windows(spark, made):
    series = report.prepared_series(*made)
    at = report.centres(series)
    got = report.features_at(series, at).collect()
    s = series.orderBy("rec", "i").toPandas()
    assert {r["rec"] for r in got} == {1, 2} and {r["grp"] for r in got} == {"pre", "control"}
    assert len([r for r in got if r["rec"] == 1 and r["grp"] == "pre"]) == 25 and s["rec"].nunique() == 3
    for r in got:
        x, t = (s[s["rec"] == r["rec"]][c].to_numpy() for c in ("x", "t"))
        assert r["centre"] - 1500 >= t[0]
        three, five = ((t >= r["centre"] - w) & (t <= r["centre"]) for w in (180, 300))
        v, d, w = x[three] * 1000, np.diff(x[three]) * 1000, x[five] * 1000
        want = {
            "RRMean_3": v.mean(), "RRMin_3": v.min(), "RRMax_3": v.max(), "RRVar_3": v.var(ddof=1), "SDNN_3": v.std(ddof=1), "RMSSD_3": np.sqrt((d * d).mean()), "SDSD_3": d.std(ddof=1),
            "NN50_3": (abs(d) > 50).sum(), "pNN50_3": 100 * (abs(d) > 50).mean(), "SD1_5": np.diff(w).std(ddof=1) / np.sqrt(2), "SD2_5": (w[1:] + w[:-1]).std(ddof=1) / np.sqrt(2),
            "SampEn_3": K.sample_entropy(x[three], version=2), "ApEn_5": K.approximate_entropy(x[five], version=2),
        }
        for name, value in want.items():
            assert math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-9), name
        assert r["LF_POWER_5"] > 0 and 0 < r["LF_NORM_5"] + r["HF_NORM_5"] < 100.1 and r["TOTAL_POWER_25"] >= r["VLF_POWER_25"] > 0
    control = sorted(r["centre"] for r in got if r["rec"] == 1 and r["grp"] == "control")
    assert len(set(np.round(np.diff(control), 6))) == 1 and control[0] == 3000 and control[-1] < 6200 - 1500


def test_report_joins_all_parts(spark, made):
    rows, permanova = report.report(*made, permutations=99)
    got = {r["feature"]: r for r in rows.collect()}
    assert set(got) <= set(report.PLAIN + report.SHAPES) and len(got) > 15
    for r in got.values():
        assert r["n_pre"] == 50 and r["n_control"] > 20 and 0 <= r["p"] <= 1 and 0 <= r["u"] <= r["n_pre"] * r["n_control"]
    p = permanova.first()
    assert p["permutations"] == 99 and 0 < p["p"] <= 1 and p["pseudo_f"] >= 0
    assert report.report(made[0].where(F.col("rec") == 4), made[1])[0].collect() == []
