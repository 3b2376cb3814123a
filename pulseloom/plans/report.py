"""The statistical report: how beats ahead of a seizure differ from a control period, feature by feature.

Of each recording the beats up to its first late seizure are cleaned; features of the trailing
3, 5 and 25 minutes are taken at the minutes ahead of the onset, and at as many times spread over
the control period before them; every such time is a sample of one of two groups. The report
holds means, effect size, Mann-Whitney's U and p of each feature, and PERMANOVA over all.

All recordings are used. A recording needs 100 intervals before cleaning and 50 after it, data up
to its onset (the last interval may reach beyond it), and 25 minutes of control.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions import kernels as K
from pulseloom.operators import cleaning, stats
from pulseloom.operators.tachogram import RR_MOST
from pulseloom.sources.store import staged

#: Minutes ahead of the onset; the onset's least time in seconds; intervals before and after cleaning.
MINUTES, LEAST_ONSET_S, BEFORE, AFTER = 25, 3000, 100, 50
PLAIN = ["RRMean_3", "RRMin_3", "RRMax_3", "RRVar_3", "SDNN_3", "RMSSD_3", "SDSD_3", "NN50_3", "pNN50_3", "SD1_5", "SD2_5", "SD1toSD2_5"]
SHAPES = ["SampEn_3", "ApEn_5", "LF_NORM_5", "HF_NORM_5", "LF_POWER_5", "HF_POWER_5", "ln_LF_TO_HF_5", "TOTAL_POWER_25", "VLF_POWER_25", "VLF_NORM_25"]


def prepared_series(beats: DataFrame, onsets: DataFrame) -> DataFrame:
    """(rec, i, x, t, onset): cleaned beats up to the onset (rec, onset in seconds) of each recording that has enough of them."""
    # What is long enough, and what is cleaned, both look at this table.
    ahead = staged(beats.join(onsets, "rec").where(F.col("t_ms") <= F.col("onset") * 1000), "report-beats")
    enough = ahead.groupBy("rec").agg(F.count("*").alias("n"), F.max("t_ms").alias("last"), F.max("onset").alias("onset"))
    enough = enough.where((F.col("n") >= BEFORE) & (F.col("last") + RR_MOST >= F.col("onset") * 1000)).select("rec", "onset")
    clean = cleaning.cleaned(ahead.drop("onset").join(enough, "rec", "left_semi"))
    kept = clean.groupBy("rec").agg(F.count("*").alias("n")).where(F.col("n") >= AFTER)
    return clean.join(kept.select("rec"), "rec", "left_semi").join(enough, "rec").select("rec", "i", "x", F.col("t_s").alias("t"), "onset")


def centres(series: DataFrame) -> DataFrame:
    """(rec, grp, k, centre): "pre" at each of the 25 minutes ahead of the onset, "control" at as many times spread over the period before; all with 25 minutes of data behind them."""
    span = MINUTES * 60
    facts = series.groupBy("rec").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("onset").alias("onset"))
    start, end = F.greatest("t0", F.lit(float(span))), F.col("onset") - float(span)
    facts = facts.withColumns({"a": start + span, "z": end}).where(end - start >= span)
    pre = facts.select("rec", "t0", F.lit("pre").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("k"), F.col("onset").cast("double").alias("c"))
    pre = pre.withColumn("centre", F.col("c") - F.col("k") * 60)
    n = F.least(F.lit(MINUTES), F.floor((F.col("z") - F.col("a")) / 60)).cast("int")
    control = facts.withColumn("n", n).where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    control = control.withColumn("centre", F.col("a") + F.col("k") * (F.col("z") - F.col("a")) / F.col("n")).where("centre <= t1")
    both = pre.select("rec", "t0", "grp", "k", "centre").unionByName(control.select("rec", "t0", F.lit("control").alias("grp"), "k", "centre"))
    return both.where(F.col("centre") - span >= F.col("t0")).select("rec", "grp", "k", "centre")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SHAPES]))
def shapes(x: pd.Series, t: pd.Series, centre: pd.Series) -> pd.DataFrame:
    """Entropies and powers of windows of 25 minutes (and of their last 3 and 5), null below 5 beats."""
    rows = []
    for v, s, c in zip(x, t, centre, strict=True):
        v, s, row = np.asarray(v, float), np.asarray(s, float), {}
        three, five = s >= c - 180, s >= c - 300
        if three.sum() >= 5:
            row["SampEn_3"] = K.sample_entropy(v[three], version=2)
        if five.sum() >= 5:
            f, p = _density(s[five], v[five], 256, 2)
            lf, hf, total = K.band_power(f, p, *K.LF) * 1e6, K.band_power(f, p, *K.HF) * 1e6, K.band_power(f, p, 0.0, 2.0) * 1e6
            norm = (lambda y, whole=total: 100 * y / whole if whole > 0 else 0.0)
            row |= {"ApEn_5": K.approximate_entropy(v[five], version=2), "LF_NORM_5": norm(lf), "HF_NORM_5": norm(hf), "LF_POWER_5": lf, "HF_POWER_5": hf}
            row["ln_LF_TO_HF_5"] = float(np.log(lf / hf)) if lf > 0 and hf > 0 else 0.0
        if len(v) >= 5:
            f, p = _density(s, v, 2048, 4)
            vlf, total = K.band_power(f, p, *K.VLF) * 1e6, K.band_power(f, p, 0.0, 2.0) * 1e6
            row |= {"TOTAL_POWER_25": total, "VLF_POWER_25": vlf, "VLF_NORM_25": 100 * vlf / total if total > 0 else 0.0}
        rows.append(row)
    return pd.DataFrame(rows, columns=SHAPES)


def _density(t: np.ndarray, x: np.ndarray, most: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Welch's density of a window on an even grid of 4 Hz by Akima, segments of at most a part of it; nothing for 10 points or fewer."""
    _, even = K.resampled(t, x, 4.0, "akima")
    return K.welch(even, 4.0, min(most, len(even) // parts)) if len(even) > 10 else (np.zeros(0), np.zeros(0))


def features_at(series: DataFrame, at: DataFrame, with_shapes: bool = True) -> DataFrame:
    """(rec, grp, k, centre, features) of the windows that end at given times, in milliseconds; null below 5 beats.

    A window asks the whole minutes that it reaches into, and meets the beats of these only; a beat
    is in one, and is not copied ahead of the join. Successive differences come from one lag, and count where both beats are in the window.
    """
    order = Window.partitionBy("rec").orderBy("i")
    s = series.select("rec", "i", "x", "t", F.lag("x").over(order).alias("xb"), F.lag("t").over(order).alias("tb"))
    s = s.withColumn("cell", F.floor(F.col("t") / 60))
    cells = F.explode(F.sequence(F.floor((F.col("centre") - MINUTES * 60) / 60), F.floor(F.col("centre") / 60)))
    rows = at.withColumn("cell", cells).join(s, ["rec", "cell"]).where((F.col("t") <= F.col("centre")) & (F.col("t") >= F.col("centre") - MINUTES * 60))
    ms, d, both = F.col("x") * 1000, (F.col("x") - F.col("xb")) * 1000, (F.col("x") + F.col("xb")) * 1000

    def of(minutes: int, value: Column, pair: bool = False) -> Column:
        start = F.col("centre") - minutes * 60
        return F.when((F.col("t") >= start) & ((F.col("tb") >= start) if pair else F.lit(True)), value)

    three, d3, d5, s5 = of(3, ms), of(3, d, True), of(5, d, True), of(5, both, True)
    root = F.sqrt(F.lit(2.0))
    nn50 = F.count_if(F.abs(d3) > 50)
    agg = {
        "n3": F.count(three), "n5": F.count(of(5, ms)), "RRMean_3": F.avg(three), "RRMin_3": F.min(three), "RRMax_3": F.max(three), "RRVar_3": F.var_samp(three), "SDNN_3": F.stddev_samp(three),
        "RMSSD_3": F.sqrt(F.avg(d3 * d3)), "SDSD_3": F.stddev_samp(d3), "NN50_3": nn50.cast("double"), "pNN50_3": F.try_divide(nn50 * 100.0, F.count(d3)),
        "SD1_5": F.stddev_samp(d5) / root, "SD2_5": F.stddev_samp(s5) / root,
    }
    if with_shapes:
        agg["w"] = F.sort_array(F.collect_list(F.struct("i", "x", "t")))  # 25 minutes of beats at most
    out = rows.groupBy("rec", "grp", "k", "centre").agg(*[v.alias(n) for n, v in agg.items()])
    out = out.withColumn("SD1toSD2_5", F.when(F.col("SD2_5") > 0, F.col("SD1_5") / F.col("SD2_5")).otherwise(0.0))
    enough = lambda name: F.when(F.col(f"n{name[-1]}") >= 5, F.col(name)).alias(name)
    plain = ["rec", "grp", "k", "centre", *[enough(n) for n in PLAIN]]
    if not with_shapes:
        return out.select(*plain)
    shaped = out.withColumn("s", shapes(F.transform("w", lambda v: v["x"]), F.transform("w", lambda v: v["t"]), F.col("centre")))
    return shaped.select(*plain, *[F.col(f"s.{n}").alias(n) for n in SHAPES])


def samples(features: DataFrame, names: list[str]) -> DataFrame:
    """(sample_id, grp, feature, value): each time as a sample."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("v")
    return features.select(F.concat_ws("/", F.col("rec").cast("string"), "grp", F.col("k").cast("string")).alias("sample_id"), "grp", pairs).select("sample_id", "grp", "v.*")


def report(beats: DataFrame, onsets: DataFrame, with_shapes: bool = True, permutations: int = 999) -> tuple[DataFrame, DataFrame]:
    """((feature, mean_pre, mean_control, effect_size, n_pre, n_control, u, p), (pseudo_f, p, permutations)) of standardised features that vary."""
    series = staged(prepared_series(beats, onsets), "report-series")
    at = staged(features_at(series, centres(series), with_shapes), "report-features")
    long = stats.prepared(samples(at, PLAIN + (SHAPES if with_shapes else [])))
    effect = stats.effect_size(long, "pre", "control").withColumnsRenamed({"mean_a": "mean_pre", "mean_b": "mean_control"})
    ranks = stats.mann_whitney(long, "pre", "control").withColumnsRenamed({"n1": "n_pre", "n2": "n_control"})
    return effect.join(ranks, "feature"), stats.permanova(long, permutations)
