"""Lomb-Scargle against Welch on cleaned tachograms, from the parts of the engine.

Both spectra are sums over pieces of a recording: of blocks of beats for the one, of
overlapping segments for the other, so that no task holds more of it than a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import cleaning, peaks, resample, spectral
from pulseloom.sources.store import staged

BANDS = {"total": (0.003, 0.4), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}
#: Frequencies of the periodogram; rate, segment and overlap of Welch's method.
LOW, HIGH, FREQUENCIES = 0.003, 0.5, 1000
RATE_MS, SEGMENT, OVERLAP = 250, 2048, 1536
#: A peak has this share of the largest power at least, and no higher one nearer than so many frequencies.
HEIGHT, APART = 0.1, 10


def peak_count(spectrum: DataFrame, name: str) -> DataFrame:
    """(rec, name): the number of peaks of (rec, k, p)."""
    found = spectral.local_maxima(spectrum.select("rec", F.col("k").alias("f"), "p"), ["rec"], HEIGHT)
    kept = peaks.apart(found.select("rec", F.col("f").cast("long").alias("pos"), F.col("p").alias("height")), "rec", APART)
    return kept.groupBy("rec").agg(F.count("*").cast("int").alias(name))


def psd_comparison(beats: DataFrame, least: int = 20) -> DataFrame:
    """A row a recording with ``least`` beats: powers and peaks by Lomb-Scargle and by Welch (Akima, 2048 points, no detrend), and their differences."""
    beats = staged(beats, "comparison-beats")  # counted, cleaned, and counted again at the end
    n = beats.groupBy("rec").agg(F.count("*").alias("n_rr_intervals")).where(F.col("n_rr_intervals") >= least)
    # What several steps read is written once: a few numbers a beat, and a spectrum a recording.
    clean = staged(cleaning.cleaned(beats.join(n, "rec", "left_semi"), merge=False, retime=False), "comparison-clean")
    density = staged(spectral.lomb_density(clean.select("rec", "i", F.col("t_s").alias("t"), "x"), LOW, HIGH, FREQUENCIES), "comparison-density")
    knots = clean.select("rec", F.col("i").alias("beat_idx"), (F.col("x") * 1000).alias("rr_ms"), F.round(F.col("t_s") * 1000).cast("long").alias("t_ms"))
    even = staged(resample.resampled(knots, RATE_MS, "akima"), "comparison-even")
    welch = staged(spectral.welch(even, 1000 / RATE_MS, SEGMENT, OVERLAP, detrend=False), "comparison-welch")
    both = n.join(spectral.bands(density, ["rec"], {f"{k}_a": v for k, v in BANDS.items()}), "rec").join(spectral.bands(welch, ["rec"], {f"{k}_b": v for k, v in BANDS.items()}), "rec")
    both = both.join(peak_count(density, "peaks_a"), "rec", "left").join(peak_count(welch, "peaks_b"), "rec", "left").na.fill(0, ["peaks_a", "peaks_b"])

    def over(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    both = both.withColumns({"q_a": over(F.col("lf_a"), F.col("hf_a")), "q_b": over(F.col("lf_b"), F.col("hf_b"))})
    apart = lambda x: over(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")), F.col(f"{x}_b")) * 100
    logs = F.when((F.col("q_a") > 0) & (F.col("q_b") > 0), F.abs(F.ln(F.when(F.col("q_a") > 0, F.col("q_a"))) - F.ln(F.when(F.col("q_b") > 0, F.col("q_b")))))
    return both.select(
        "rec", apart("total").alias("total_diff"), apart("q").alias("lf_hf_diff"), logs.alias("ln_lf_hf_diff"), apart("hf").alias("hf_diff"),
        F.abs(F.col("peaks_a") - F.col("peaks_b")).alias("peak_count_diff"), "n_rr_intervals", F.col("total_a").alias("total_power_ls"), F.col("total_b").alias("total_power_welch"),
        F.col("q_a").alias("lf_hf_ls"), F.col("q_b").alias("lf_hf_welch"),
    )
