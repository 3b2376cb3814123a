"""From a tree of recordings to feature rows of training windows, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.columns import is_seizure
from pulseloom.operators import features, labels, signal, windows
from pulseloom.operators.tachogram import rr_from_peaks
from pulseloom.schemas import FEATURES
from pulseloom.sources import edf, files

#: What a row says of its minute besides its features.
STATUS = [*(f"bin_{i}" for i in range(1, 5)), "is_ictal", "is_postictal", "recent_seizure_flag", "training_mask"]
#: Recordings shorter than this, in seconds, need a seizure.
SHORT_S = 3600


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(rec, subject_id, recording_id, run and its files): runs with both signals; rec is a number for each."""
    runs = files.complete(files.matched(files.categorised(files.listed(spark, root))))
    name = F.regexp_extract("ecg_file", r"([^/]+)\.edf$", 1)
    return runs.withColumns({"recording_id": name, "subject_id": F.coalesce(F.nullif(F.regexp_extract(name, r"(sub-[^_]*)", 1), F.lit("")), F.lit("unknown")), "rec": F.xxhash64(name)})


def seizures(spark: SparkSession, root: str) -> DataFrame:
    """(run_name, idx, onset_s, dur_s): seizures by the name that a run's files share."""
    events = files.annotations(spark, f"{root}/*/*/eeg/*_events.tsv")
    return events.where(is_seizure("eventType")).select(F.col("recording_id").alias("run_name"), "idx", F.col("onset").alias("onset_s"), F.col("duration").alias("dur_s"))


def window_rows(spark: SparkSession, root: str, fs: float = 256.0) -> DataFrame:
    """Rows of all 60-minute windows of all runs below ``root`` (sub-*/ses-*/eeg and ecg).

    A run's length is that of its EEG. Beats come from the first channel of its ECG:
    band-pass, peaks, intervals, bounds. Runs below an hour without a seizure, and runs
    without two beats, give nothing; others below an hour give one padded window, if it
    has a minute near a seizure.
    """
    runs = tree(spark, root)
    length = edf.load(spark, root, header_only=True, name="*_eeg.edf").select(F.col("recording_id").alias("eeg_id"), "duration_s")
    events = seizures(spark, root)
    eeg = F.regexp_extract("eeg_file", r"([^/]+)\.edf$", 1)
    runs = runs.withColumns({"eeg_id": eeg, "run_name": F.regexp_replace(eeg, "_eeg$", "")}).join(length, "eeg_id")
    ictal = events.select("run_name").distinct().withColumn("seized", F.lit(True))
    runs = runs.join(ictal, "run_name", "left").where((F.col("duration_s") >= SHORT_S) | F.col("seized"))
    peaks = signal.r_peaks(edf.load(spark, root, name="*_ecg.edf"), fs)
    peaks = peaks.join(runs.select("rec", "recording_id"), "recording_id").select("rec", "beat_idx", "sample")
    beats = rr_from_peaks(peaks, fs).select("rec", "beat_idx", (F.col("rr_s") * 1000).alias("rr_ms"), (F.col("t_s") * 1000).alias("t_ms"))
    full = runs.select("rec", F.floor(F.col("duration_s") / 60).cast("int").alias("full")).where("full > 0")
    full = full.join(beats.select("rec").distinct(), "rec", "left_semi")
    minutes = full.select("rec", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("minute"))
    rows = minutes.join(signal.minute_features(beats, full), ["rec", "minute"], "left")
    rows = features.availability(rows, FEATURES)
    z = events.join(runs.select("run_name", "rec"), "run_name").drop("run_name")
    rows = rows.join(labels.status(minutes, z), ["rec", "minute"])
    both = windows.hopping(rows).unionByName(windows.padded(rows))
    return both.join(runs.select("rec", "subject_id", "recording_id"), "rec").select(
        "subject_id", "recording_id", "window_start_time", "window_end_time", (F.col("minute") * 60.0).alias("minute_time"), "minute_in_window",
        *FEATURES, *STATUS, "mask", "is_padded",
    )
