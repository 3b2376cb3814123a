"""Hopping windows of minute rows, padding of short recordings, and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, HOP = 60, 30


def hopping(rows: DataFrame, size: int = SIZE, hop: int = HOP, order: str = "minute") -> DataFrame:
    """Rows of each full window: adds k, minute_in_window, window_start_time, window_end_time (seconds), is_padded.

    Window k holds the rows hop * k to hop * k + size - 1 of a recording, if all are there.
    """
    w = Window.partitionBy("rec").orderBy(order)
    rows = rows.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("rec"))})
    low = F.greatest(F.ceil((F.col("_r") - size + 1) / hop), F.lit(0)).cast("int")
    high = F.least(F.floor(F.col("_r") / hop), F.floor((F.col("_n") - size) / hop)).cast("int")
    rows = rows.where((F.col("_n") >= size) & (low <= high)).withColumn("k", F.explode(F.sequence(low, high)))
    inside = Window.partitionBy("rec", "k")
    return rows.withColumns({
        "minute_in_window": (F.col("_r") - F.col("k") * hop).cast("int"),
        "window_start_time": F.min(order).over(inside) * 60.0,
        "window_end_time": F.max(order).over(inside) * 60.0 + 60.0,
        "is_padded": F.lit(False),
    }).drop("_r", "_n")


def padded(rows: DataFrame, size: int = SIZE, order: str = "minute") -> DataFrame:
    """The single window of recordings shorter than ``size``: their last row is repeated, marked is_padded.

    Recordings without any minute in bin 1 or 2 are dropped. training_mask is copied as it is.
    """
    w = Window.partitionBy("rec").orderBy(order)
    rows = rows.withColumns({
        "_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("rec")),
        "_near": F.max(F.greatest("bin_1", "bin_2")).over(Window.partitionBy("rec")),
    }).where((F.col("_n") < size) & (F.col("_near") > 0))
    r = F.col("_r").cast("int")
    j = F.when(F.col("_r") == F.col("_n") - 1, F.sequence(r, F.lit(size - 1))).otherwise(F.array(r))
    rows = rows.withColumn("minute_in_window", F.explode(j))
    whole = Window.partitionBy("rec")
    return rows.withColumns({
        "k": F.lit(0), "window_start_time": F.min(order).over(whole) * 60.0, "window_end_time": F.max(order).over(whole) * 60.0 + 60.0,
        "is_padded": F.col("minute_in_window") >= F.col("_n"),
    }).drop("_r", "_n", "_near")


def run_summary(rows: DataFrame) -> DataFrame:
    """Counts of window rows of each recording."""
    return rows.groupBy("rec").agg(
        F.count("*").alias("n_minutes"),
        F.countDistinct("window_start_time", "window_end_time").alias("n_windows"),
        F.sum(F.col("is_padded").cast("int")).alias("n_padded_minutes"),
        *[F.sum(c).alias(a) for c, a in (("is_ictal", "n_ictal_minutes"), ("is_postictal", "n_postictal_minutes"), ("training_mask", "n_training_minutes"), ("bin_1", "n_bin_1"), ("bin_2", "n_bin_2"), ("bin_3", "n_bin_3"), ("bin_4", "n_bin_4"))],
    )


def dataset_totals(summary: DataFrame) -> DataFrame:
    """Sums over recordings, and the shares of the bins in percent."""
    names = ["n_minutes", "n_windows", "n_ictal_minutes", "n_postictal_minutes", "n_training_minutes", "n_bin_1", "n_bin_2", "n_bin_3", "n_bin_4"]
    total = summary.agg(F.count("*").alias("n_runs"), *[F.sum(c).cast("bigint").alias(c) for c in names])
    return total.select("*", *[F.round(F.col(f"n_bin_{i}") * 100.0 / F.col("n_minutes"), 6).alias(f"pct_bin_{i}") for i in range(1, 5)])


def sequences(rows: DataFrame, features: list[str], size: int = SIZE) -> DataFrame:
    """(rec, window_start_time, x, y, ts, final_mask) of windows with exactly ``size`` rows.

    final_mask is training_mask without rows that lack a feature or are padded; rows that
    lack one have all features set to 0.
    """
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    x = F.array(*[F.when(bad, F.lit(0.0)).otherwise(F.col(f)).cast("float") for f in features])
    row = F.struct(
        F.col("minute_in_window").alias("j"), x.alias("x"), F.array(*[f"bin_{i}" for i in range(1, 5)]).alias("y"), (F.col("minute") * 60.0).alias("t"),
        ((F.col("training_mask") == 1) & ~bad & ~F.col("is_padded")).alias("m"),
    )
    out = rows.groupBy("rec", "window_start_time", "window_end_time").agg(F.sort_array(F.collect_list(row)).alias("w")).where(F.size("w") == size)
    return out.select("rec", "window_start_time", F.col("w.x").alias("x"), F.col("w.y").alias("y"), F.col("w.t").alias("ts"), F.col("w.m").alias("final_mask"))
