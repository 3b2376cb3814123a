"""Functions in SQL text."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pulseloom.functions import kernels as K
from pulseloom.functions.sql import register

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def series(spark):
    register(spark)
    x = {0: RNG.normal(size=1000), 1: RNG.normal(size=256), 2: RNG.normal(size=40), 3: np.ones(300)}
    spark.createDataFrame([(k, v.tolist()) for k, v in x.items()] + [(4, None)], "rec long, x array<double>").createOrReplaceTempView("series_of_tests")
    return x


def test_scalar_functions(spark, series):
    rows = spark.sql("SELECT rec, samp_en(x) a, samp_en_v2(x) b, ap_en(x) c, ap_en_v2(x) d, norm_sf(rec - 2D) z, norm_sf(NULL) none FROM series_of_tests").collect()
    for r in rows:
        x = series.get(r["rec"])
        want = [0.0] * 4 if x is None else [K.sample_entropy(x), K.sample_entropy(x, version=2), K.approximate_entropy(x), K.approximate_entropy(x, version=2)]
        assert np.allclose([r["a"], r["b"], r["c"], r["d"]], want)
        assert math.isclose(r["z"], 0.5 * math.erfc((r["rec"] - 2) / math.sqrt(2))) and r["none"] is None
    got = spark.sql("SELECT band_power(array(0D, 0.1D, 0.2D, 0.3D), array(1D, 1D, 1D, 1D), 0.1D, 0.3D) p").first()["p"]
    assert math.isclose(got, 0.2)


def test_table_function_of_arrays(spark, series):
    got = {}
    for r in spark.sql("SELECT rec, w.f, w.p FROM series_of_tests, LATERAL welch_psd(x, 4.0D, 256) w").collect():
        got.setdefault(r["rec"], []).append((r["f"], r["p"]))
    assert set(got) == set(series)
    for k, x in series.items():
        f, p = K.welch(x, 4.0, 256)
        assert np.allclose(sorted(got[k]), list(zip(f, p, strict=True)))


def test_table_function_of_partitions(spark, series):
    """In order of i, whatever the order of the rows; one segment is held."""
    spark.sql("SELECT rec, i, v AS x FROM series_of_tests LATERAL VIEW posexplode(x) AS i, v ORDER BY rand(1)").repartition(5).createOrReplaceTempView("values_of_tests")
    got = {}
    for r in spark.sql("SELECT * FROM welch_series(TABLE(values_of_tests) PARTITION BY rec ORDER BY (i), 4.0D, 256)").collect():
        got.setdefault(r["rec"], []).append((r["k"], r["f"], r["p"]))
    assert set(got) == set(series)
    for k, x in series.items():
        f, p = K.welch(x, 4.0, 256)
        assert np.allclose(sorted(got[k]), list(zip(range(len(f)), f, p, strict=True)))
