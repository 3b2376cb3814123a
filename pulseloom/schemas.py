"""Schemas of the engine's tables, and the guard for columns that a caller must bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUN = "subject string, session string, run string, eeg_file string, ecg_file string, annotation_file string"
EVENT = "recording_id string, idx int, eventType string, onset double, duration double"
SIGNAL = "recording_id string, fs double, start_sample bigint, samples array<float>"
BEAT = "rec bigint, beat_idx bigint, rr_ms bigint, t_ms bigint"
SPECTRUM = T.ArrayType(T.StructType([T.StructField("f", T.DoubleType()), T.StructField("p", T.DoubleType())]))

#: Feature names in output order: 3-, 5- and 10-minute windows.
TIME_3 = ["RRMean_3", "RRMin_3", "RRMax_3", "RRVar_3", "RMSSD_3", "SDNN_3", "SDSD_3", "NN50_3", "pNN50_3", "SampEn_3"]
GEOMETRY_5 = ["ApEn_5", "SD1_5", "SD2_5", "SD1toSD2_5"]
FREQUENCY_10 = ["TOTAL_POWER_10", "LF_NORM_10", "HF_NORM_10", "LF_POWER_10", "HF_POWER_10", "LF_TO_HF_10", "VLF_POWER_10", "VLF_NORM_10"]
FEATURES = TIME_3 + GEOMETRY_5 + FREQUENCY_10


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or ValueError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
