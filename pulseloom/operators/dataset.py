"""Class weights, splits and scaling of training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(rows: DataFrame, classes: int = 4) -> DataFrame:
    """(cls, weight): balanced weights n / (k * n_c) of each recording's trainable rows, averaged over recordings.

    rows: (rec, cls, trainable). Absent classes weigh 1; so do all where one class or none is there.
    """
    rows = rows.where("trainable")
    n = rows.groupBy("rec", "cls").agg(F.count("*").alias("n_c"))
    whole = Window.partitionBy("rec")
    n = n.withColumns({"n": F.sum("n_c").over(whole), "k": F.count("*").over(whole)})
    spine = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    every = rows.select("rec").distinct().join(F.broadcast(spine))
    w = F.when(F.col("k") > 1, F.col("n") / (F.col("k") * F.col("n_c"))).otherwise(1.0)
    got = every.join(n, ["rec", "cls"], "left").select("cls", F.coalesce(w, F.lit(1.0)).alias("w"))
    return got.groupBy("cls").agg(F.round(F.avg("w"), 6).alias("weight"))


def class_distribution(rows: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """(by, cls, n) of all rows, whether trainable or not."""
    return rows.groupBy(*by, "cls").agg(F.count("*").alias("n"))


def split(subjects: DataFrame, order: Column, test: float = 0.2, val: float = 0.2, fixed: dict[str, list] | None = None) -> DataFrame:
    """(subject, split): train, val and test by subject; ``order`` stands for the random order.

    Of n subjects, max(1, int(n * test)) are for test and max(1, int((n - n_test) * val))
    for val; val=0 or test=0 leaves that split out. ``fixed`` names subjects of a split.
    """
    rows = subjects.select("subject").distinct()
    fixed = fixed or {}
    place = F.lit(None).cast("string")
    for name, ids in fixed.items():
        place = F.when(F.col("subject").isin(list(ids)), name).otherwise(place)
    rows = rows.withColumn("_fixed", place)
    free = rows.where("_fixed is null").withColumns({"_k": F.row_number().over(Window.orderBy(order, "subject")), "_n": F.count("*").over(Window.partitionBy())})
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * test)) if test and "test" not in fixed else F.lit(0)
    n_val = F.greatest(F.lit(1), F.floor((F.col("_n") - n_test) * val)) if val and "val" not in fixed else F.lit(0)
    name = F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train")
    return free.select("subject", name.alias("split")).unionByName(rows.where("_fixed is not null").select("subject", F.col("_fixed").alias("split")))


def split_by(rows: DataFrame, subjects: Sequence | None = None, recordings: Sequence | None = None) -> DataFrame:
    """``rows`` with split: val for the named subjects, or else for the named recordings; train for the rest."""
    chosen = F.col("subject").isin(list(subjects)) if subjects else F.col("recording").isin(list(recordings or []))
    return rows.withColumn("split", F.when(chosen, "val").otherwise("train"))


def split_rows(rows: DataFrame, draw: Column, val: float = 0.2) -> DataFrame:
    """``rows`` with split by row, which lets rows of one patient fall on both sides; ``draw`` is between 0 and 1."""
    return rows.withColumn("split", F.when(draw < val, "val").otherwise("train"))


def scaler(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population deviation; a deviation of zero counts as 1."""
    agg = [F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f) for f in features]
    one = rows.agg(*agg)
    each = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean").alias("mean"), F.col(f"{f}.std").alias("std")) for f in features])).alias("s"))
    return each.select("s.feature", "s.mean", F.when(F.col("s.std") == 0, 1.0).otherwise(F.col("s.std")).alias("std"))


def scaled(rows: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with features standardised; the scaler is one row when pivoted."""
    wide = fitted.agg(*[F.max(F.when(F.col("feature") == f, F.struct("mean", "std"))).alias(f"_{f}") for f in features])
    out = rows.join(F.broadcast(wide))
    return out.select(*[c for c in rows.columns if c not in features], *[((F.col(f) - F.col(f"_{f}")["mean"]) / F.col(f"_{f}")["std"]).alias(f) for f in features])
