"""Seizure proximity of minutes, and validation of seizures. Times in seconds unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import SEIZURE_CODES, one_hot, proximity_bin

POSTICTAL_S, FIRST_S, APART_S = 1800, 1200, 1800
#: Seconds of a cell in which samples and events meet.
CELL_S = 60


def nearest(minutes: DataFrame, seizures: DataFrame) -> DataFrame:
    """(rec, minute, nearest_s): distance to the nearest onset, before or after; null without any.

    The onsets of a recording are few and go along as one sorted array, so minutes aren't multiplied.
    """
    onsets = seizures.groupBy("rec").agg(F.collect_list("onset_s").alias("_on"))
    at = F.col("minute") * 60
    away = F.array_min(F.transform("_on", lambda s: F.abs(s - at)))
    return minutes.join(onsets, "rec", "left").select("rec", "minute", away.cast("bigint").alias("nearest_s"))


def ictal(minutes: DataFrame, seizures: DataFrame) -> DataFrame:
    """(rec, minute, is_ictal) by the interval join onset <= t < onset + duration."""
    spans = seizures.groupBy("rec").agg(F.collect_list(F.struct("onset_s", "dur_s")).alias("_z"))
    at = F.col("minute") * 60
    hit = F.exists("_z", lambda z: (z["onset_s"] <= at) & (at < z["onset_s"] + z["dur_s"]))
    return minutes.join(spans, "rec", "left").select("rec", "minute", F.coalesce(hit, F.lit(False)).cast("int").alias("is_ictal"))


def status(minutes: DataFrame, seizures: DataFrame) -> DataFrame:
    """(rec, minute, bin_1..4, is_ictal, is_postictal, recent_seizure_flag, training_mask).

    Events are taken in file order: the first ictal one ends the search, and post-ictal
    ones before it still count. Excluded minutes have no bin; others the bin of the
    nearest onset, 4 without seizures. A null duration is never ictal.
    """
    z = F.struct("idx", "onset_s", "dur_s")
    events = seizures.groupBy("rec").agg(F.sort_array(F.collect_list(z)).alias("_z"))
    at = F.col("minute") * 60
    first = F.array_min(F.transform(F.filter("_z", lambda e: (e["onset_s"] <= at) & (at < e["onset_s"] + e["dur_s"])), lambda e: e["idx"]))
    rows = minutes.join(events, "rec", "left").withColumn("_first", first)
    after = F.exists("_z", lambda e: (at - e["onset_s"]).between(0, POSTICTAL_S) & (F.col("_first").isNull() | (e["idx"] < F.col("_first"))))
    rows = rows.withColumns({"is_ictal": F.col("_first").isNotNull().cast("int"), "is_postictal": F.coalesce(after, F.lit(False)).cast("int")})
    away = F.array_min(F.transform("_z", lambda e: F.abs(e["onset_s"] - at))) / 60
    free = (F.col("is_ictal") == 0) & (F.col("is_postictal") == 0)
    rows = rows.withColumn("_bin", F.when(free, F.when(F.col("_z").isNull(), 4).otherwise(proximity_bin(away))))
    return rows.select(
        "rec", "minute", *one_hot(F.col("_bin"), 4), "is_ictal", "is_postictal",
        F.col("is_postictal").alias("recent_seizure_flag"), free.cast("int").alias("training_mask"),
    )


def validated(seizures: DataFrame) -> DataFrame:
    """``seizures`` with is_valid: onset at 20 minutes or later, and not within 30 minutes after a valid one; an equal onset stays valid.

    Only distinct onsets decide. An onset that is further than 30 minutes after the one before
    it is valid whatever came earlier: there a recording is cut, and each piece is scanned
    alone. Times are whole seconds, so that a piece is bounded by its length, however many
    events it has.
    """
    onsets = seizures.where(F.col("onset_s") >= FIRST_S).select("rec", "onset_s").distinct()
    order = Window.partitionBy("rec").orderBy("onset_s")
    far = F.coalesce(F.col("onset_s") - F.lag("onset_s").over(order) > APART_S, F.lit(True))
    pieces = onsets.withColumn("_far", far.cast("long")).withColumn("_piece", F.sum("_far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lone = F.col("_n") == 1
    pieces = pieces.groupBy("rec", "_piece").agg(F.sort_array(F.collect_list("onset_s")).alias("_on"), F.count("*").alias("_n"))

    def step(kept: Column, at: Column) -> Column:
        return F.when(at - F.element_at(kept, -1) > APART_S, F.concat(kept, F.array(at))).otherwise(kept)

    kept = F.when(lone, F.col("_on")).otherwise(F.aggregate(F.slice("_on", 2, F.size("_on")), F.slice("_on", 1, 1), step))
    valid = pieces.select("rec", F.explode(kept).alias("onset_s"), F.lit(True).alias("_valid"))
    return seizures.join(valid, ["rec", "onset_s"], "left").withColumn("is_valid", F.coalesce("_valid", F.lit(False))).select(*seizures.columns, "is_valid")


def valid_counts(checked: DataFrame) -> DataFrame:
    """(rec, total, valid, excluded, excluded_pct) from :func:`validated`."""
    valid = F.count_if("is_valid")
    return checked.groupBy("rec").agg(
        F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("excluded"),
        F.round((F.count("*") - valid) * 100.0 / F.count("*"), 6).alias("excluded_pct"),
    )


def top_patients(counts: DataFrame, n: int) -> DataFrame:
    """The n recordings with most valid seizures, the smaller id first on ties."""
    return counts.orderBy(F.desc("valid"), "rec").limit(n)


def first_event(seizures: DataFrame, kind: str, least_s: float) -> DataFrame:
    """The first event of a type at ``least_s`` or later, of each recording; file order breaks ties."""
    rows = seizures.where((F.col("eventType") == kind) & (F.col("onset_s") >= least_s))
    first = F.row_number().over(Window.partitionBy("rec").orderBy("onset_s", "idx"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k").withColumn("onset_minutes", F.round(F.col("onset_s") / 60, 6))


def named(events: DataFrame, kind: str = "eventType") -> DataFrame:
    """``events`` with name: that of a seizure's numeric code, null for any other kind. A lookup of 38 rows."""
    names = events.sparkSession.createDataFrame(list(SEIZURE_CODES.items()), "_code string, name string")
    return events.join(F.broadcast(names), F.lower(F.trim(kind)) == F.col("_code"), "left").drop("_code")


def with_fallback(events: DataFrame, is_target: str = "is_sz") -> DataFrame:
    """Target events of each recording, or all its events where it has no target."""
    n = F.count_if(F.col(is_target)).over(Window.partitionBy("rec"))
    return events.withColumn("_n", n).where(F.col(is_target) | (F.col("_n") == 0)).drop("_n")


# -- labels of single samples ----------------------------------------------------------


def label_spans(seizures: DataFrame, n_samples: int | Column, fs: int, sph_s: int, width_s: int) -> DataFrame:
    """(rec, start, end, label, idx): half-open sample ranges; 1 around onset - sph, 2 while ictal.

    ``n_samples`` may be a column of ``seizures``, the length of its recording.

    A target window needs onset >= sph + width / 2 and must not reach its own seizure's onset.
    """
    centre, half = F.col("onset_s") - sph_s, width_s / 2
    target = seizures.where((F.col("onset_s") >= sph_s + half) & (centre + half <= F.col("onset_s")))
    cut = lambda x: F.least(F.greatest(x.cast("bigint"), F.lit(0)), F.lit(n_samples)).cast("bigint")
    one = target.select("rec", cut((centre - half) * fs).alias("start"), cut((centre + half) * fs).alias("end"), F.lit(1).alias("label"), "idx")
    two = seizures.select("rec", cut(F.col("onset_s") * fs).alias("start"), cut((F.col("onset_s") + F.col("dur_s")) * fs).alias("end"), F.lit(2).alias("label"), "idx")
    return one.unionByName(two).where(F.col("start") < F.col("end"))


def pieces(spans: DataFrame, cell: int) -> DataFrame:
    """(rec, cell, start, end, label): what spans (rec, start, end, label, idx) make of each cell of ``cell`` samples, as runs that don't overlap.

    A sample has the label of the last event that covers it, ictal first within an event. Spans
    go to the cells that they reach into; there the ends of all of them cut the cell into
    stretches, each of which has one winner. So many spans of one recording never meet in one
    place, only those of one cell do.
    """
    first, last = F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)
    rows = spans.withColumn("cell", F.explode(F.sequence(first, last)))
    low, high = F.greatest("start", F.col("cell") * cell), F.least("end", (F.col("cell") + 1) * cell)
    rows = rows.groupBy("rec", "cell").agg(F.collect_list(F.struct("idx", "label", low.alias("a"), high.alias("b"))).alias("z"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("z", lambda s: s["a"]), F.transform("z", lambda s: s["b"]))))
    rows = rows.withColumn("cuts", cuts)

    def stretch(i: Column) -> Column:
        start = F.get("cuts", i)
        over = F.filter("z", lambda s: (s["a"] <= start) & (start < s["b"]))
        best = F.array_max(F.transform(over, lambda s: F.struct(s["idx"].alias("idx"), s["label"].alias("label"))))
        return F.struct(start.alias("start"), F.get("cuts", i + 1).alias("end"), best["label"].alias("label"))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), stretch)).alias("s")
    return rows.select("rec", "cell", each).select("rec", "cell", "s.*").where("label IS NOT NULL")


def runs(spans: DataFrame, lengths: DataFrame, cell: int) -> DataFrame:
    """(rec, start, end, label): each recording as runs of equal labels from 0 to its n samples, those without a label as 0. lengths: (rec, n)."""
    order = Window.partitionBy("rec").orderBy("start")
    p = pieces(spans, cell).drop("cell")
    goes_on = F.coalesce((F.lag("end").over(order) == F.col("start")) & (F.lag("label").over(order) == F.col("label")), F.lit(False))
    p = p.withColumn("_new", (~goes_on).cast("long")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = p.groupBy("rec", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("_run")
    gaps = full.select("rec", "start", "end").unionByName(lengths.select("rec", F.col("n").cast("long").alias("start"), F.col("n").cast("long").alias("end")))
    gaps = gaps.select("rec", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long")).alias("_from"), F.col("start").alias("_to")).where("_from < _to")
    return full.unionByName(gaps.select("rec", F.col("_from").alias("start"), F.col("_to").alias("end"), F.lit(0).alias("label")))


def samples_of(run: DataFrame) -> DataFrame:
    """(rec, sample, label) of every sample of :func:`runs`."""
    return run.select("rec", F.explode(F.sequence("start", F.col("end") - 1)).alias("sample"), "label")


def labels_at(points: DataFrame, spans: DataFrame, cell: int) -> DataFrame:
    """``points`` (rec, sample, ...) with label, 0 where no span covers the sample; points meet the runs of their cell only."""
    there = pieces(spans, cell).groupBy("rec", F.col("cell").alias("_cell")).agg(F.collect_list(F.struct("start", "end", "label")).alias("_z"))
    rows = points.withColumn("_cell", F.floor(F.col("sample") / cell)).join(there, ["rec", "_cell"], "left")
    hit = F.filter("_z", lambda s: (s["start"] <= F.col("sample")) & (F.col("sample") < s["end"]))
    return rows.withColumn("label", F.coalesce(F.get(hit, F.lit(0))["label"], F.lit(0))).drop("_z", "_cell")


def label_stats(run: DataFrame, fs: int) -> DataFrame:
    """Counts, shares and durations of the labels 0, 1 and 2, a row each, from lengths of :func:`runs`."""
    spine = run.sparkSession.createDataFrame([(0,), (1,), (2,)], "label int")
    n = run.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    rows = F.broadcast(spine).join(n, "label", "left").na.fill(0, ["n"])
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy()))  # three rows
    return rows.select("label", "n", F.round(F.col("n") * 100.0 / F.greatest("total", F.lit(1)), 6).alias("pct"), F.round(F.col("n") / fs, 6).alias("seconds"))


def label_check(seizures: DataFrame, spans: DataFrame, fs: int, sph_s: int, width_s: int) -> DataFrame:
    """(rec, idx, target_possible, has_target, has_ictal) for each event: whether a sample of its reach bears the label.

    Reaches of events meet the runs of the cells that they touch.
    """
    cell = CELL_S * fs
    there = pieces(spans, cell).groupBy("rec", "label", "cell").agg(F.collect_list(F.struct("start", "end")).alias("z"))
    centre, half = F.col("onset_s") - sph_s, width_s / 2
    reach = lambda label, a, b: F.struct(F.lit(label).alias("label"), F.ceil(a * fs).alias("a"), F.ceil(b * fs).alias("b"))
    events = seizures.select("rec", "idx", (F.col("onset_s") >= sph_s + half).alias("target_possible"), F.explode(F.array(
        reach(1, centre - half, centre + half), reach(2, F.col("onset_s"), F.col("onset_s") + F.col("dur_s")),
    )).alias("x")).select("rec", "idx", "target_possible", "x.*")
    first, last = F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell)
    asked = events.withColumn("cell", F.explode_outer(F.when(first <= last, F.sequence(first, last))))
    met = asked.join(there, ["rec", "label", "cell"], "left")
    met = met.withColumn("hit", F.coalesce(F.exists("z", lambda s: F.greatest(s["start"], F.col("a")) < F.least(s["end"], F.col("b"))), F.lit(False)))
    return met.groupBy("rec", "idx", "target_possible").agg(F.bool_or((F.col("label") == 1) & F.col("hit")).alias("has_target"), F.bool_or((F.col("label") == 2) & F.col("hit")).alias("has_ictal"))


def window_centre_labels(points: DataFrame, spans: DataFrame, size: int, step: int, cell: int) -> DataFrame:
    """(rec, k, centre, label) of all hop windows of ``size`` samples; points: (rec, n_samples)."""
    n = F.floor((F.col("n_samples") - size) / step)
    rows = points.where(F.col("n_samples") >= size).select("rec", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"))
    rows = rows.withColumn("sample", (F.col("k") * step + size // 2).cast("bigint"))
    return labels_at(rows, spans, cell).withColumnRenamed("sample", "centre")
