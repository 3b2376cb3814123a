"""Every query against its SQL; those without SQL must run and give rows."""

from __future__ import annotations


import numpy as np
import pytest

from compare import same
from pulseloom import catalog
from pulseloom.sources.fixtures import beats, seizures

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same(catalog.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_operators_that_cannot_be_imported_leave_the_other_queries(monkeypatch):
    import builtins
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("pulseloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def without(name, *a, **k):
        if name in ("ahocorasick", "corpus_pipeline"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    jobs = {"job1_training_set", "job2_annotation_notes"}
    assert set(__spark_entry__.queries()) == set(catalog.queries()) | jobs and set(__spark_entry__.oracle_sql()) == set(SQL) | jobs


def test_queries_with_content(spark, sf_dir):
    q = catalog.queries()
    assert q["set_minus"](spark, sf_dir).count() > 0
    runs = q["run_match"](spark, sf_dir).collect()
    assert any(r["ecg_file"] is None for r in runs) or any(r["eeg_file"] is None for r in runs) or len(runs) > 100


def test_entry(spark):
    import __spark_entry__

    assert {"rec", "minute", "RRMean_3", "pNN50_3"} <= set(__spark_entry__.entry(spark).columns)


def test_statistics_of_all_orders(spark, sf_dir):
    q = catalog.queries()
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus IN ('F', 'O')").count()
    assert q["feature_prep"](spark, sf_dir).select("sample_id").distinct().count() == n
    f, p = (q[x](spark, sf_dir).first()["pseudo_f"] for x in ("permanova_f", "permanova"))
    assert abs(f - p) < 1e-5 and all(r["n1"] + r["n2"] == n for r in q["mann_whitney"](spark, sf_dir).where("feature = 'key'").collect())


def test_permanova_has_the_permutations_of_the_reference(spark, sf_dir):
    assert catalog.queries()["permanova"](spark, sf_dir).first()["permutations"] == 999


def test_labels_of_all_samples_equal_painted_ones(spark, sf_dir):
    ends = {r["rec"]: r["t"] * 4 // 1000 for r in beats(spark, sf_dir).groupBy("rec").agg({"t_ms": "max"}).toDF("rec", "t").collect()}
    painted = {rec: [0] * n for rec, n in ends.items()}
    for z in sorted(seizures(spark, sf_dir, dense=True).collect(), key=lambda r: r["idx"]):
        x = painted.get(z["rec"], [])
        if z["onset_s"] >= 360:
            for i in range((z["onset_s"] - 360) * 4, min((z["onset_s"] - 240) * 4, len(x))):
                x[i] = 1
        for i in range(z["onset_s"] * 4, min((z["onset_s"] + z["dur_s"]) * 4, len(x))):
            x[i] = 2
    got = {r["label"]: (r["n"], r["seconds"]) for r in catalog.queries()["label_stats"](spark, sf_dir).collect()}
    want = [sum(x.count(v) for x in painted.values()) for v in range(3)]
    assert got == {v: (n, n / 4) for v, n in enumerate(want)} and sum(want) == sum(ends.values()) and want[1] and want[2]


def test_spectra_of_all_windows_equal_brute_force(spark, sf_dir):
    q, b = catalog.queries(), beats(spark, sf_dir).orderBy("rec", "beat_idx").collect()
    rows = [r for r in b if r["rec"] == b[0]["rec"]]
    rec, last = b[0]["rec"], rows[-1]["t_ms"] // 60000
    clean = [r for r in rows if 200 <= r["rr_ms"] <= 2000]

    def window(minute, m):
        w = [r for r in clean if (minute - m) * 60000 <= r["t_ms"] <= minute * 60000]
        return [r["rr_ms"] / 1000 for r in w], [r["t_ms"] / 1000 for r in w]

    minutes = set(range(10, last))
    for name in ("lomb_scargle_10", "lomb_density_10"):
        out = q[name](spark, sf_dir).where(f"rec = {rec}").groupBy("minute").count().collect()
        assert {r["minute"] for r in out} == minutes and all(r["count"] == 1000 for r in out)
    from pulseloom.functions.kernels import sample_entropy

    got = {r["minute"]: r["samp_en"] for r in q["samp_en_v2"](spark, sf_dir).where(f"rec = {rec}").collect()}
    assert set(got) == set(range(3, last)) and all(abs(got[m] - sample_entropy(np.array(window(m, 3)[0]), version=2)) < 1e-6 for m in (3, 40, last - 1))


def test_welch_takes_all_beats(spark, sf_dir):
    b = [r for r in beats(spark, sf_dir).orderBy("rec", "beat_idx").collect() if r["rec"] == 0]
    x = np.array([r["rr_ms"] / 1000 for r in b])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    p = np.mean([np.abs(np.fft.rfft((x[i : i + 256] - x[i : i + 256].mean()) * w)) ** 2 for i in range(0, len(x) - 255, 128)], axis=0) / (w * w).sum()
    p[1:-1] *= 2
    got = sorted((r["f"], r["p"]) for r in catalog.queries()["welch_psd"](spark, sf_dir).where("rec = 0").collect())
    assert np.allclose([v for _, v in got], p, atol=1e-6)
