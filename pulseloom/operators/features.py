"""Features of trailing windows at each full minute.

A beat is dealt to the minutes whose window holds it, so that windows become an equality
grouping: at most ``minutes + 1`` copies of a beat, and no range join. Successive
differences come from one ``lag`` over the recording; the pair counts for a window if its
first beat lies in the window too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K
from pulseloom.operators.tachogram import in_order, physiologic

MINUTE = 60_000


def grid(beats: DataFrame) -> DataFrame:
    """(rec, minute): all full minutes of a recording, from 0."""
    n = beats.groupBy("rec").agg(F.floor(F.max("t_ms") / MINUTE).cast("int").alias("n")).where("n >= 1")
    return n.select("rec", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("minute"))


def dealt(beats: DataFrame, minutes: int) -> DataFrame:
    """Clean beats with each minute whose trailing window holds them, both ends included.

    Adds ``_prev`` and ``_prev_t``: the clean beat before, whether or not it is in the window.
    """
    clean = beats.where(physiologic())
    clean = clean.withColumns({"_prev": F.lag("rr_ms").over(in_order()), "_prev_t": F.lag("t_ms").over(in_order())})
    low = F.greatest(F.ceil(F.col("t_ms") / MINUTE), F.lit(minutes))
    high = F.floor((F.col("t_ms") + minutes * MINUTE) / MINUTE)
    return clean.where(low <= high).withColumn("minute", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def difference(minutes: int) -> Column:
    """Successive difference inside the window of ``minute``; null for its first beat."""
    start = (F.col("minute") - minutes) * MINUTE
    return F.when(F.col("_prev_t") >= start, F.col("rr_ms") - F.col("_prev"))


def windows(beats: DataFrame, minutes: int, least: int, aggregates: list[Column]) -> DataFrame:
    """(rec, minute, aggregates) of windows with at least ``least`` beats; minutes as in :func:`grid`."""
    rows = dealt(beats, minutes).withColumns({"d": difference(minutes)})
    rows = rows.withColumn("s", F.when(F.col("d").isNotNull(), F.col("rr_ms") + F.col("_prev")))
    out = rows.groupBy("rec", "minute").agg(F.count("*").alias("n"), *aggregates).where(F.col("n") >= least)
    full = beats.groupBy("rec").agg(F.floor(F.max("t_ms") / MINUTE).alias("_full"))
    return out.join(full, "rec").where(F.col("minute") < F.col("_full")).drop("_full")


def time_domain(beats: DataFrame, minutes: int = 3, least: int = 5) -> DataFrame:
    """Mean, extremes, variance, RMSSD, SDNN, SDSD, NN50 and pNN50, in milliseconds."""
    d, rr = F.col("d"), F.col("rr_ms")
    s = f"_{minutes}"
    nn50 = F.count_if(F.abs(d) > 50)
    r = lambda c: F.round(c, 6)
    return windows(beats, minutes, least, [
        r(F.avg(rr)).alias(f"RRMean{s}"), F.min(rr).alias(f"RRMin{s}"), F.max(rr).alias(f"RRMax{s}"), r(F.var_samp(rr)).alias(f"RRVar{s}"),
        r(F.sqrt(F.avg(d * d))).alias(f"RMSSD{s}"), r(F.stddev_samp(rr)).alias(f"SDNN{s}"), r(F.stddev_samp(d)).alias(f"SDSD{s}"),
        nn50.alias(f"NN50{s}"), r(F.try_divide(nn50 * 100.0, F.count("*") - 1)).alias(f"pNN50{s}"),
    ])


def poincare(beats: DataFrame, minutes: int = 5, least: int = 10) -> DataFrame:
    """SD1, SD2 and their ratio."""
    sd1, sd2 = F.stddev_samp("d") / F.sqrt(F.lit(2.0)), F.stddev_samp("s") / F.sqrt(F.lit(2.0))
    s = f"_{minutes}"
    ratio = F.when(sd2 > 0, sd1 / sd2).otherwise(0.0)
    return windows(beats, minutes, least, [F.round(sd1, 6).alias(f"SD1{s}"), F.round(sd2, 6).alias(f"SD2{s}"), F.round(ratio, 6).alias(f"SD1toSD2{s}")])


def at_centres(beats: DataFrame, centres: DataFrame, minutes: int, least: int = 5) -> DataFrame:
    """(rec, centre_ms, n, mean, deviation) of windows that end at given times; null features below ``least`` beats.

    A window asks the whole-minute cells that it reaches into; a beat is in one, and is not copied.
    """
    b = beats.where(physiologic()).select("rec", "rr_ms", "t_ms", F.floor(F.col("t_ms") / MINUTE).alias("_cell"))
    cells = F.sequence(F.floor((F.col("centre_ms") - minutes * MINUTE) / MINUTE), F.floor(F.col("centre_ms") / MINUTE))
    c = centres.select("rec", "centre_ms", F.explode(cells).alias("_cell"))
    inside = F.col("t_ms").between(F.col("centre_ms") - minutes * MINUTE, F.col("centre_ms"))
    rows = c.join(b, ["rec", "_cell"], "left").withColumn("rr_ms", F.when(inside, F.col("rr_ms")))
    n = F.count("rr_ms")
    return rows.groupBy("rec", "centre_ms").agg(
        n.alias("n"), F.when(n >= least, F.round(F.avg("rr_ms"), 6)).alias("mean_rr"), F.when(n >= least, F.round(F.stddev_samp("rr_ms"), 6)).alias("sd_rr")
    )


def _series(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x): the values of each window as one array, in order of i."""
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"].cast("double")).alias("x"))


def entropy_counts(rows: DataFrame, m: int, r: float, keys: list[str]) -> DataFrame:
    """(keys, n, B, A): template pairs of length m and m + 1 within the tolerance (Chebyshev), among the first n - m templates for both.

    rows: (keys, i, x), a window of bounded length for each key. Its pairs are compared where
    the window is; only their numbers leave it.
    """
    @F.pandas_udf("B long, A long")
    def counts(windows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.template_pairs(np.asarray(x), m, r) for x in windows], columns=["B", "A"])

    return _series(rows, keys).select(*keys, F.size("x").cast("long").alias("n"), counts("x").alias("_c")).select(*keys, "n", "_c.*")


def sample_entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """-ln(A / B); 0 where a count is 0."""
    return counts.select(*keys, "n", "A", "B", F.when((F.col("A") > 0) & (F.col("B") > 0), F.round(-F.ln(F.col("A") / F.col("B")), 6)).otherwise(0.0).alias("samp_en"))


def approximate_entropy(rows: DataFrame, m: int, r: float, keys: list[str]) -> DataFrame:
    """(keys, n, ap_en): version 2, self-matches counted, the mean logarithms divided by the number of templates less m - 1; 0 for a constant window.

    rows: as for :func:`entropy_counts`.
    """
    @F.pandas_udf("double")
    def of(windows: pd.Series) -> pd.Series:
        return pd.Series([K.approximate_entropy(np.asarray(x), m, r, 2) for x in windows], dtype=float)

    return _series(rows, keys).select(*keys, F.size("x").cast("long").alias("n"), of("x").alias("ap_en"))


def availability(features: DataFrame, columns: list[str]) -> DataFrame:
    """``features`` with mask (1 if all columns are there), mask_ratio, and nulls set to 0."""
    has = [F.col(c).isNotNull().cast("int") for c in columns]
    total = has[0]
    for h in has[1:]:
        total = total + h
    out = features.withColumns({"mask": F.least(*has) if len(has) > 1 else has[0], "mask_ratio": F.round(total / len(columns), 6)})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
