"""From beats and seizures to a training set, as one plan: window rows, splits, scaler, weights, sequences."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.columns import class_of
from pulseloom.operators import dataset, features, labels, windows

#: Features of trailing windows that are aggregations of beats, in output order.
TIME_3 = ["RRMean_3", "RRMin_3", "RRMax_3", "RRVar_3", "RMSSD_3", "SDNN_3", "SDSD_3", "NN50_3", "pNN50_3"]
POINCARE_5 = ["SD1_5", "SD2_5", "SD1toSD2_5"]
BINS = [f"bin_{i}" for i in range(1, 5)]


def minute_rows(beats: DataFrame, seizures: DataFrame) -> DataFrame:
    """(rec, minute, features, mask, status) of every full minute; features that a window has too few beats for are 0 and unmasked."""
    grid, keys = features.grid(beats), ["rec", "minute"]
    got = grid.join(features.time_domain(beats).drop("n"), keys, "left").join(features.poincare(beats).drop("n"), keys, "left")
    rows = features.availability(got, TIME_3 + POINCARE_5).drop("mask_ratio")
    return rows.join(labels.status(grid, seizures), keys)


def window_rows(minutes: DataFrame) -> DataFrame:
    """Rows of all 60-minute windows, hopping by 30, and of the padded window of shorter recordings; final_mask: what training may look at."""
    both = windows.hopping(minutes).unionByName(windows.padded(minutes))
    fine = (F.col("training_mask") == 1) & (F.col("mask") == 1) & ~F.col("is_padded")
    return both.withColumn("final_mask", fine)


class TrainingSet(NamedTuple):
    """rows: with split and scaled features; scaler: (feature, mean, std) of the training split; weights: (cls, weight) of it."""

    rows: DataFrame
    scaler: DataFrame
    weights: DataFrame


def assembled(rows: DataFrame, names: Sequence[str], order: Column, test: float = 0.2, val: float = 0.2, subject: str = "rec", fixed: dict[str, list] | None = None) -> TrainingSet:
    """A training set of window rows: subjects are dealt to splits, and scaler and weights come from the training split alone.

    order: stands for the random order of the subjects. Window rows are read three times
    (scaler, weights, rows): give a table that is written.
    """
    names = list(names)
    dealt = dataset.split(rows.select(F.col(subject).alias("subject")), order, test, val, fixed)
    rows = rows.join(dealt.withColumnRenamed("subject", subject), subject)
    train = rows.where("split = 'train'")
    scaler = dataset.scaler(train, names)
    weights = dataset.class_weights(train.select("rec", class_of(BINS).alias("cls"), F.col("final_mask").alias("trainable")))
    return TrainingSet(dataset.scaled(rows, scaler, names), scaler, weights)
