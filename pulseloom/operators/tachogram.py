"""Tachograms: beats from peaks, artifacts, cleaning and timelines. Times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Physiologic bounds of an interval, both kept.
RR_LEAST, RR_MOST = 200, 2000


def by_rec() -> WindowSpec:
    return Window.partitionBy("rec")


def in_order() -> WindowSpec:
    return by_rec().orderBy("beat_idx")


def rr_from_peaks(peaks: DataFrame, fs: float) -> DataFrame:
    """(rec, beat_idx, rr_s, t_s) from (rec, beat_idx, sample): an interval bears the time of its second peak."""
    before = F.lag("sample").over(in_order())
    rows = peaks.withColumn("_before", before).where(F.col("_before").isNotNull())
    return rows.select("rec", "beat_idx", ((F.col("sample") - F.col("_before")) / fs).alias("rr_s"), (F.col("sample") / fs).alias("t_s"))


def physiologic(rr: str | Column = "rr_ms") -> Column:
    """Whether an interval is within the physiologic bounds."""
    return (F.col(rr) if isinstance(rr, str) else rr).between(RR_LEAST, RR_MOST)


def with_artifacts(beats: DataFrame, method: str = "threshold") -> DataFrame:
    """``beats`` with is_artifact: 'threshold' (bounds), 'mad' (3 MAD around the median), or 'iqr' (1.5 IQR)."""
    if method == "threshold":
        return beats.withColumn("is_artifact", ~physiologic())
    if method == "mad":
        middle = beats.groupBy("rec").agg(F.expr("percentile(rr_ms, 0.5)").alias("_median"))
        spread = beats.join(middle, "rec").groupBy("rec").agg(F.first("_median").alias("_median"), F.expr("percentile(abs(rr_ms - _median), 0.5)").alias("_mad"))
        return beats.join(spread, "rec").withColumn("is_artifact", F.abs(F.col("rr_ms") - F.col("_median")) > 3 * F.col("_mad")).drop("_median", "_mad")
    if method == "iqr":
        q = quartiles(beats)
        wide = 1.5 * (F.col("_q3") - F.col("_q1"))
        out = (F.col("rr_ms") < F.col("_q1") - wide) | (F.col("rr_ms") > F.col("_q3") + wide)
        return beats.join(q, "rec").withColumn("is_artifact", out).drop("_q1", "_q3", "_n")
    raise ValueError(f"unknown artifact method: {method}")


def quartiles(beats: DataFrame) -> DataFrame:
    q = F.expr("percentile(rr_ms, array(0.25D, 0.75D))")
    return beats.groupBy("rec").agg(q.alias("q"), F.count("*").alias("_n")).select("rec", F.col("q")[0].alias("_q1"), F.col("q")[1].alias("_q3"), "_n")


def winsorised(beats: DataFrame, retime: bool = True) -> DataFrame:
    """Intervals outside 1.5 IQR are set to the quartile on their side; fewer than 4 beats stay as they are.

    With ``retime`` the time axis is rebuilt from the first beat: t[i] = t[i-1] + rr[i-1].
    """
    wide = 1.5 * (F.col("_q3") - F.col("_q1"))
    low, high = F.col("rr_ms") < F.col("_q1") - wide, F.col("rr_ms") > F.col("_q3") + wide
    rows = beats.join(quartiles(beats), "rec")
    rr = F.when(F.col("_n") < 4, F.col("rr_ms").cast("double")).when(low, F.col("_q1")).when(high, F.col("_q3")).otherwise(F.col("rr_ms").cast("double"))
    rows = rows.withColumn("rr_w", rr)
    moved = F.first("t_ms").over(in_order()) + F.coalesce(F.sum("rr_w").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = F.when(F.col("_n") < 4, F.col("t_ms").cast("double")).otherwise(moved) if retime else F.col("t_ms").cast("double")
    return rows.select("rec", "beat_idx", "rr_w", t.alias("t_w"))


def interpolated(beats: DataFrame) -> DataFrame:
    """Artifacts replaced by linear interpolation over time between clean neighbours, extrapolated at the ends.

    Recordings with one clean beat keep only it; without any, nothing is left.
    """
    rows = beats.withColumn("_ok", physiologic())
    point = F.when(F.col("_ok"), F.struct("t_ms", "rr_ms"))
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, so that each frame extends the one before.
    after = by_rec().orderBy(F.desc("beat_idx")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_a": F.last(point, ignorenulls=True).over(before), "_b": F.last(point, ignorenulls=True).over(after),
        "_n": F.sum(F.col("_ok").cast("int")).over(by_rec()),
    })
    # At an end the line runs through the two nearest clean beats.
    ends = _edges(beats.where(physiologic()))
    rows = rows.join(ends, "rec", "left")
    a = F.when(F.col("_a").isNull(), F.struct(F.col("_first")["t_ms"].alias("t_ms"), F.col("_first")["rr_ms"].alias("rr_ms"))).when(
        F.col("_b").isNull(), F.struct(F.col("_last2")["t_ms"].alias("t_ms"), F.col("_last2")["rr_ms"].alias("rr_ms"))
    ).otherwise(F.col("_a"))
    b = F.when(F.col("_a").isNull(), F.struct(F.col("_first2")["t_ms"].alias("t_ms"), F.col("_first2")["rr_ms"].alias("rr_ms"))).when(
        F.col("_b").isNull(), F.struct(F.col("_last")["t_ms"].alias("t_ms"), F.col("_last")["rr_ms"].alias("rr_ms"))
    ).otherwise(F.col("_b"))
    line = a["rr_ms"] + (F.col("t_ms") - a["t_ms"]) * (b["rr_ms"] - a["rr_ms"]) / (b["t_ms"] - a["t_ms"])
    rr = F.when(F.col("_ok"), F.col("rr_ms").cast("double")).otherwise(line)
    return rows.where(F.col("_ok") | (F.col("_n") >= 2)).select("rec", "beat_idx", rr.alias("rr_i"), "t_ms", (~F.col("_ok")).alias("was_artifact"))


def _edges(clean: DataFrame) -> DataFrame:
    """(rec, _first, _first2, _last2, _last): the outermost two clean beats on each side."""
    up, down = in_order(), by_rec().orderBy(F.desc("beat_idx"))
    rows = clean.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).where("_u <= 2 or _d <= 2")
    at = lambda c, k: F.max(F.when(F.col(c) == k, F.struct("t_ms", "rr_ms")))
    return rows.groupBy("rec").agg(at("_u", 1).alias("_first"), at("_u", 2).alias("_first2"), at("_d", 2).alias("_last2"), at("_d", 1).alias("_last"))


def stats(beats: DataFrame) -> DataFrame:
    """One row a recording: counts, artifact rate, mean, population deviation and heart rate of clean beats."""
    ok = physiologic()
    rr = F.when(ok, F.col("rr_ms"))
    mean = F.avg(rr)
    return beats.groupBy("rec").agg(
        (F.count("*") + 1).alias("n_peaks"),
        F.count("*").alias("n_rr"),
        F.count_if(~ok).alias("n_artifacts"),
        F.round(F.count_if(~ok) / F.count("*"), 6).alias("artifact_rate"),
        F.round(mean, 6).alias("mean_rr_ms"),
        F.round(F.stddev_pop(rr), 6).alias("std_rr_ms"),
        F.round(F.try_divide(F.lit(60000), mean), 6).alias("mean_hr"),
    )


def between(rows: DataFrame, start: float, end: float, t: str = "t_ms") -> DataFrame:
    """A time segment, both ends included."""
    return rows.where(F.col(t).between(start, end))


def timeline(beats: DataFrame) -> DataFrame:
    """The running sum of the intervals."""
    return beats.select("rec", "beat_idx", F.sum("rr_ms").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("t_sum"))


def centred(beats: DataFrame, value: str = "rr_ms") -> DataFrame:
    """Values less their recording's mean."""
    return beats.select("rec", "beat_idx", (F.col(value) - F.avg(value).over(by_rec())).alias("x"))


def detrended(beats: DataFrame, value: str = "rr_ms", t: str = "t_ms") -> DataFrame:
    """Values less their recording's least-squares line over time."""
    line = beats.groupBy("rec").agg(F.regr_slope(value, t).alias("_m"), F.regr_intercept(value, t).alias("_c"))
    return beats.join(line, "rec").select("rec", "beat_idx", (F.col(value) - F.col("_m") * F.col(t) - F.col("_c")).alias("x"))


def time_weighted(beats: DataFrame) -> DataFrame:
    """Mean and variance of intervals held until the next beat."""
    dt = F.lead("t_ms").over(in_order()) - F.col("t_ms")
    rows = beats.select("rec", F.col("rr_ms").cast("double").alias("y"), dt.alias("dt")).where("dt is not null")
    sums = rows.groupBy("rec").agg(F.sum("dt").alias("T"), F.sum(F.col("y") * F.col("dt")).alias("s1"), F.sum(F.col("y") * F.col("y") * F.col("dt")).alias("s2"))
    mean = F.try_divide("s1", "T")
    return sums.select("rec", mean.alias("mean_tw"), (F.try_divide("s2", "T") - mean * mean).alias("var_tw"))
