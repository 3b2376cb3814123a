"""Edge cases of operators: bounds, ties, nulls and published figures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import columns as C
from pulseloom.operators import dataset, features, labels, signal, stats, tachogram, windows
from pulseloom.schemas import require_columns


def test_is_seizure_truth_table(spark):
    cases = {None: False, "": False, "bckg": False, "impd": False, "sz": True, "SZ_GEN": True, "3.6": True, "9.9": False, " Focal aware ": True, "absence": True}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "kind string, want boolean")
    assert rows.where(C.is_seizure("kind") != F.col("want")).count() == 0


def test_seizure_codes_and_names(spark):
    """Codes by group, and one name of each, as they are published."""
    members = {1: 7, 2: 5, 3: 7, 4: 4, 5: 3, 6: 8, 7: 4}
    assert set(C.SEIZURE_CODES) == {f"{g}.{i}" for g, n in members.items() for i in range(1, n + 1)} and len(C.SEIZURE_CODES) == 38
    some = {"1.7": "Focal Aware Motor - Tonic", "2.2": "Focal Aware Non-motor - Behavioral arrest", "3.6": "Focal Impaired Awareness Motor - Myoclonic", "4.4": "Focal Impaired Awareness Non-motor - Sensory",
            "5.3": "Focal to bilateral tonic-clonic - Awareness unknown at onset", "6.8": "Generalized Motor - Epileptic spasms", "7.1": "Generalized Non-motor (absence) - Typical"}
    rows = spark.createDataFrame([(f"{g}.{i}",) for g in range(10) for i in range(10)] + [(None,), ("",), (" 1.5 ",), ("sz",)], "kind string")
    got = labels.named(rows, "kind").select("kind", "name", C.is_seizure("kind").alias("sz")).collect()
    assert len(got) == 104
    for r in got:
        known = (r["kind"] or "").strip() in C.SEIZURE_CODES
        assert r["sz"] == (known or r["kind"] == "sz") and (r["name"] is not None) == known and (r["kind"] not in some or r["name"] == some[r["kind"]])


def test_paths_and_classes(spark):
    r = spark.createDataFrame([("/x/sub-001_ses-01_run-03_eeg.edf",), ("/x/other.edf",)], "p string").select(C.run_number("p").alias("r"), C.subject_id("p").alias("s")).collect()
    assert [tuple(x) for x in r] == [("03", "001"), (None, "unknown")]
    rows = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 0)], "a int, b int, c int, d int")
    assert [x[0] for x in rows.select(C.class_of(["a", "b", "c", "d"])).collect()] == [0, 2]


def test_window_edges_are_inclusive(spark):
    t = [0, 1000, 60000, 120000, 180000, 240000, 300001]
    beats = spark.createDataFrame([(1, i + 1, 800 + i, x) for i, x in enumerate(t)], "rec long, beat_idx long, rr_ms long, t_ms long")
    got = {r["minute"]: r["n"] for r in features.time_domain(beats, 3, 1).collect()}
    assert got == {3: 5, 4: 4}  # minute 5 would begin after the last full minute


def test_status_order_of_events(spark):
    minutes = spark.createDataFrame([(1, m) for m in (0, 10, 20, 60, 200)], "rec long, minute int")
    z = spark.createDataFrame([(1, 1, 300, 10), (1, 2, 580, 60), (1, 3, 590, None)], "rec long, idx long, onset_s long, dur_s long")
    got = {r["minute"]: (r["is_ictal"], r["is_postictal"], r["bin_1"] + 2 * r["bin_2"] + 3 * r["bin_3"] + 4 * r["bin_4"]) for r in labels.status(minutes, z).collect()}
    assert got[10] == (1, 1, 0) and got[0] == (0, 0, 2) and got[20] == (0, 1, 0) and got[60] == (0, 0, 3) and got[200] == (0, 0, 4)
    none = labels.status(minutes, z.limit(0)).collect()
    assert all(r["bin_4"] == 1 and r["training_mask"] == 1 for r in none)


def test_validation_keeps_equal_onsets(spark):
    z = spark.createDataFrame([(1, 1, 1000), (1, 2, 1300), (1, 3, 1300), (1, 4, 3100), (1, 5, 3101)], "rec long, idx long, onset_s long")
    assert [r["is_valid"] for r in labels.validated(z).orderBy("idx").collect()] == [False, True, True, False, True]


def test_split_sizes_and_fixed(spark):
    s = spark.range(10).select(F.col("id").alias("subject"))
    got = dataset.split(s, F.col("subject")).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in got} == {"test": 2, "val": 1, "train": 7}
    got = dataset.split(s, F.col("subject"), fixed={"test": [9]}).collect()
    assert {r["subject"] for r in got if r["split"] == "test"} == {9}


def test_scaler_of_a_constant_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = dataset.scaled(rows, dataset.scaler(rows, ["a", "b"]), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(-1.0, 0.0), (1.0, 0.0)]


def test_mann_whitney_p_of_published_figures(spark):
    """U = 2031 and 2004 of 50 and 50 without ties."""
    for u, p in ((2031, 7.4227e-08), (2004, 2.0528e-07)):
        n1 = n2 = 50
        z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
        got = spark.range(1).select(stats.erfc(F.lit(z / math.sqrt(2))).alias("p")).first()["p"]
        assert math.isclose(got, p, rel_tol=1e-4)


def test_permanova_of_clear_groups(spark):
    rows = [(i, "a" if i < 10 else "b", "x", float(i % 10) + (0 if i < 10 else 100)) for i in range(20)]
    long = spark.createDataFrame(rows, "sample_id long, grp string, feature string, value double")
    r = stats.permanova(long, 99).first()
    assert r["pseudo_f"] > 100 and r["p"] <= 0.05 and r["permutations"] == 99


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 100, 1000])
def test_every_permutation_is_one(spark, n):
    """All numbers go to all places, each time in another order; numbering is dense."""
    from pulseloom.operators import permutations as P

    rows = P.numbered(spark.range(n).select((F.col("id") * 7919 % 10_007).alias("k")), "k")
    rows = rows.withColumn("n", F.lit(n).cast("long")).withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    got = {}
    for r in P.placed(rows, "no", "perm", "n").orderBy("perm", "no").collect():
        got.setdefault(r["perm"], []).append((r["no"], r["place"]))
    assert len(got) == 10 and all([i for i, _ in v] == list(range(n)) and sorted(p for _, p in v) == list(range(n)) for v in got.values())
    assert n < 97 or len({tuple(v) for v in got.values()}) == 10


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_places_of_arrays_are_those_of_columns(spark, n):
    from pulseloom.operators import permutations as P

    rows = spark.range(n).withColumnRenamed("id", "no").withColumn("n", F.lit(n).cast("long")).withColumn("perm", F.explode(F.array(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    got = {(r["perm"], r["no"]): r["place"] for r in P.placed(rows, "no", "perm", "n").collect()}
    for perm in (0, 7):
        assert P.places(np.arange(n), perm, n, P.keyed(42)).tolist() == [got[perm, i] for i in range(n)]


def test_permanova_copies_no_sample_for_a_permutation(spark):
    """Values that are missing, three groups: p is that of each permutation done by itself, and no row is exploded by permutation."""
    from pulseloom.operators import permutations as P

    rows = [(i, "abc"[i % 3], f, float((i * 37 + k * 11) % 23) + i % 3) for i in range(60) for k, f in enumerate(("x", "y")) if (i + k) % 7]
    samples = sorted({r[0] for r in rows})
    long = spark.createDataFrame(rows, "sample_id long, grp string, feature string, value double")
    df = stats.permanova(long, 50)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan and "explode(v" in plan
    numbers = {r["sample_id"]: r["no"] for r in P.numbered(spark.createDataFrame([(s,) for s in samples], "sample_id long"), "sample_id", "no").collect()}
    groups = sorted("abc"[s % 3] for s in samples)

    def f(group):
        out = {"sst": 0.0, "ssw": 0.0}
        for name in ("x", "y"):
            v = np.array([r[3] for r in rows if r[2] == name])
            g = np.array([group(r) for r in rows if r[2] == name])
            out["sst"] += ((v - v.mean()) ** 2).sum()
            out["ssw"] += sum(((v[g == k] - v[g == k].mean()) ** 2).sum() for k in "abc")
        return (out["sst"] - out["ssw"]) / 2 / (out["ssw"] / (max(sum(r[2] == n for r in rows) for n in ("x", "y")) - 3))

    seen = f(lambda r: r[1])
    places = [P.places(np.arange(len(samples)), p, len(samples), P.keyed(42)) for p in range(50)]
    stars = [f(lambda r, at=at: groups[at[numbers[r[0]]]]) for at in places]
    r = df.first()
    assert abs(r["pseudo_f"] - seen) < 1e-9 and r["permutations"] == 50
    assert r["p"] == (sum(x >= seen for x in stars) + 1) / 51


def test_permutations_are_even(spark):
    """Each sample is in the first half in about half of the permutations, and pairs go apart in about half."""
    from pulseloom.operators import permutations as P

    n, perms = 200, 400
    rows = spark.range(n).withColumnRenamed("id", "no").withColumn("n", F.lit(n).cast("long")).withColumn("perm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(perms - 1).cast("long"))))
    t = P.placed(rows, "no", "perm", "n").withColumn("low", (F.col("place") < n // 2).cast("int"))
    share = [r["s"] for r in t.groupBy("no").agg(F.avg("low").alias("s")).collect()]
    assert max(abs(x - 0.5) for x in share) < 0.125  # five deviations
    pairs = t.alias("a").join(t.alias("b"), "perm").where("a.no = b.no + 1").groupBy("a.no").agg(F.avg((F.col("a.low") == F.col("b.low")).cast("int")).alias("s"))
    assert max(abs(r["s"] - 0.5) for r in pairs.collect()) < 0.125


def test_interpolation_edges(spark):
    rr = [2500, 800, 900, 150, 1000, 3000]
    beats = spark.createDataFrame([(1, i + 1, x, 1000 * (i + 1)) for i, x in enumerate(rr)], "rec long, beat_idx long, rr_ms long, t_ms long")
    got = [r["rr_i"] for r in tachogram.interpolated(beats).orderBy("beat_idx").collect()]
    assert got == [700.0, 800.0, 900.0, 950.0, 1000.0, 1050.0]
    one = spark.createDataFrame([(1, 1, 800, 800), (1, 2, 5000, 5800)], "rec long, beat_idx long, rr_ms long, t_ms long")
    assert tachogram.interpolated(one).count() == 1
    with pytest.raises(ValueError):
        tachogram.with_artifacts(one, "other")


def test_padding_needs_a_near_minute(spark):
    cols = "rec long, minute int, bin_1 int, bin_2 int, bin_3 int, bin_4 int, is_ictal int, is_postictal int, training_mask int"
    rows = spark.createDataFrame([(1, m, 0, int(m == 2), 0, 0, 0, 0, 1) for m in range(5)] + [(2, m, 0, 0, 0, 1, 0, 0, 1) for m in range(5)], cols)
    got = windows.padded(rows)
    assert got.count() == 60 and got.where("is_padded").count() == 55 and got.select("rec").distinct().count() == 1
    assert got.where("minute_in_window = 59").first()["minute"] == 4


def test_require_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["id", "b"])


def test_r_peaks_over_blocks(spark):
    import numpy as np

    x = np.zeros(256 * 20)
    x[100::205] = 1.0
    rows = [("r", int(i), x[i : i + 512].tolist()) for i in range(0, len(x), 512)]
    got = signal.r_peaks(spark.createDataFrame(rows, "recording_id string, start_sample long, samples array<float>"))
    assert abs(got.count() - len(x[100::205])) <= 1
    with pytest.raises(ValueError):
        signal.r_peaks(got, method="neurokit")


def test_templates_by_cells_equal_all_pairs(spark):
    """Version 2 of both entropies on windows of many shapes: few values, constants, spread, and too few beats for a template."""
    import numpy as np

    from pulseloom.functions import kernels as K

    rng = np.random.default_rng(3)
    series = [rng.integers(1, 6, 40) / 5, rng.normal(0.8, 0.1, 150), np.ones(30), rng.integers(520, 1500, 200) / 1000, np.tile([0.7, 0.9], 40), np.array([0.8, 0.9, 1.0, 0.8, 0.9]), rng.normal(-3, 2, 60), np.arange(4.0), np.array([1.0, 2.0])]
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(series) for i, v in enumerate(x)], "w long, i int, x double")
    sampled = {r["w"]: r["samp_en"] for r in features.sample_entropy(features.entropy_counts(rows, 2, 0.2, ["w"]), ["w"]).collect()}
    approximate = {r["w"]: r["ap_en"] for r in features.approximate_entropy(rows, 2, 0.2, ["w"]).collect()}
    for k, x in enumerate(series):
        assert k in sampled and (x.std() == 0 or len(x) < 4 or abs(sampled[k] - K.sample_entropy(x, version=2)) < 1e-6), k
        if len(x) >= 5:
            assert abs(approximate[k] - K.approximate_entropy(x, version=2)) < 1e-12, k


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2048, 2049, 30_000])
def test_exact_quantiles(spark, n):
    """Small and large keys, ties, nulls, and the outermost shares."""
    import numpy as np

    rng = np.random.default_rng(n)
    series = {"even": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "skewed": np.exp(4 * rng.normal(size=n))}
    shares = [0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0]
    rows = spark.createDataFrame([(k, float(v)) for k, x in series.items() for v in x] + [("even", None), ("none", None)], "k string, x double").repartition(5)
    got = {r["k"]: r["q"] for r in stats.quantiles(rows, ["k"], "x", shares).collect()}
    assert set(got) == set(series) and all(np.allclose(got[k], np.quantile(x, shares), rtol=1e-12) for k, x in series.items())
    whole = stats.quantiles(rows.where("k = 'skewed'"), [], "x", [0.5]).collect()
    assert np.isclose(whole[0]["q"][0], np.median(series["skewed"]), rtol=1e-12)


def _hours_of_beats(spark):
    rr = np.random.default_rng(5).choice([700, 800, 900, 1000], 9000).tolist()
    t = np.cumsum(rr).tolist()
    return rr, t, spark.createDataFrame([(1, i + 1, int(x), int(s)) for i, (x, s) in enumerate(zip(rr, t))], "rec long, beat_idx long, rr_ms long, t_ms long")


def test_entropies_of_windows_join_no_templates(spark):
    """Only counts leave a window: no join of its templates, whose pairs would grow with its square."""
    from pulseloom.functions import kernels as K

    rr, t, beats = _hours_of_beats(spark)
    counts, entropies = signal.sample_entropy_counts(beats, 3, 10), signal.approximate_entropies(beats, 5, 10)
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (counts, entropies))
    full = t[-1] // 60_000
    window = lambda m, k: np.array([x for x, s in zip(rr, t) if (m - k) * 60_000 <= s <= m * 60_000]) / 1000
    got = {r["minute"]: (r["n"], r["B"], r["A"]) for r in counts.collect()}
    assert set(got) == set(range(3, full))
    for m in (3, 60, full - 1):
        x = window(m, 3)
        pairs = [(i, j) for i in range(len(x) - 2) for j in range(i) if max(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) <= 0.2 * x.std()]
        assert got[m] == (len(x), len(pairs), sum(abs(x[i + 2] - x[j + 2]) <= 0.2 * x.std() for i, j in pairs))
    got = {r["minute"]: r["ap_en"] for r in entropies.collect()}
    assert set(got) == set(range(5, full)) and all(abs(got[m] - K.approximate_entropy(window(m, 5), version=2)) < 1e-9 for m in (5, 60, full - 1))


@pytest.mark.parametrize("kind", ["dft", "lomb", "density"])
def test_spectra_leave_a_block_as_arrays(spark, kind):
    """No batch of ten thousand spectra is held as objects: each block gives its own rows, and Spark unfolds them."""
    from pulseloom.functions import kernels as K

    rr, t, beats = _hours_of_beats(spark)
    df = signal.spectra(beats, kind)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" in plan
    for m in (10, 61):
        x, s = (np.array(v) / 1000 for v in zip(*[(x, s) for x, s in zip(rr, t) if (m - 10) * 60_000 <= s <= m * 60_000]))
        f = {"dft": np.arange(len(x) // 2 + 1) / len(x), "lomb": np.linspace(0.001, 0.5, 1000), "density": np.linspace(0.003, 0.5, 1000)}[kind]
        p = {"dft": lambda: np.abs(np.fft.rfft(x)) ** 2, "lomb": lambda: K.lomb_scargle(np.arange(len(x), dtype=float), x, f, True), "density": lambda: K.lomb_density(s, x)[1]}[kind]()
        rows = df.where(f"minute = {m}").orderBy("k").collect()
        assert len(rows) == len(f) and np.allclose([r["f"] for r in rows], f, rtol=0, atol=1e-12) and np.allclose([r["p"] for r in rows], p)


@pytest.mark.parametrize(("n", "segment", "overlap"), [(5, 64, None), (64, 64, 48), (8191, 64, None), (8192, 64, 48), (20_000, 64, 0)])
def test_welch_by_blocks_of_segments(spark, n, segment, overlap):
    """A block of segments travels once, not a copy of each value for each segment, and borders of blocks lose none."""
    from pulseloom.functions import kernels as K
    from pulseloom.operators import spectral

    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "rec long, i long, x double")
    df = spectral.welch(rows, 4.0, segment, overlap, detrend=False)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()
    f, p = K.welch(x, 4.0, segment, overlap, False)
    got = df.orderBy("k").collect()
    assert np.allclose([r["f"] for r in got], f) and np.allclose([r["p"] for r in got], p, rtol=1e-9)


def test_only_the_minute_features_asked_for(spark):
    names = ["SampEn_3", "ApEn_5"]
    _, _, beats = _hours_of_beats(spark)
    got, every = signal.minute_features(beats, only=names), signal.minute_features(beats).select("rec", "minute", *names)
    assert got.columns == ["rec", "minute", *names] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)


def test_centre_windows_copy_no_beat(spark):
    """Windows ask cells; a beat goes to its own only, also where it is on a border of a cell or window."""
    beats = spark.createDataFrame([(1, i + 1, 1000, (i + 1) * 1000) for i in range(4000)] + [(2, 1, 800, 800)], "rec long, beat_idx long, rr_ms long, t_ms long")
    centres = spark.createDataFrame([(1, c) for c in (0, 60_000, 1_500_000, 1_500_500, 4_000_000, 9_000_000)] + [(2, 700)], "rec long, centre_ms long")
    df = features.at_centres(beats, centres, 25)
    assert "t_ms" not in [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line][0]
    got = {(r["rec"], r["centre_ms"]): (r["n"], r["mean_rr"]) for r in df.collect()}
    want = {(1, c): sum(c - 1_500_000 <= (i + 1) * 1000 <= c for i in range(4000)) for c in (0, 60_000, 1_500_000, 1_500_500, 4_000_000, 9_000_000)} | {(2, 700): 0}
    assert got == {k: (n, 1000.0 if n >= 5 else None) for k, n in want.items()}
