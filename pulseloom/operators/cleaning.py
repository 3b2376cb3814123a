"""The cleaning of tachograms ahead of spectra: merge, winsorise, centre, remove slow trends.

No step holds a recording in a task: short intervals are merged island by island, quartiles and
means are aggregates, running sums stream over sorted rows, and the filter goes by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K
from pulseloom.operators.filters import BLOCK, block_of, joined, padding, zero_phase_blocks
from pulseloom.operators.tachogram import by_rec, in_order, winsorised
from pulseloom.sources.store import staged

#: Intervals up to this, in milliseconds, are merged into a neighbour.
SHORT_MS = 250
#: Slow trends: below this frequency in Hz, by a high-pass of this order on a grid of this rate at least.
CUTOFF, ORDER, RATE = 0.003, 4, 4.0


def merged_run(run: list[int], least: int) -> tuple[list[int], int]:
    """One island: (its intervals, the place in ``run`` of what is first now).

    Intervals of at most ``least`` go into their smaller neighbour, the left one on ties, which
    keeps its place; a merge to the left steps back.
    """
    behind: list[tuple[int, int]] = []
    ahead = [(x, i) for i, x in enumerate(run)][::-1]
    while ahead:
        x, i = ahead.pop()
        if x > least or not (behind or ahead):
            behind.append((x, i))
        elif ahead and (not behind or ahead[-1][0] < behind[-1][0]):
            ahead[-1] = (ahead[-1][0] + x, ahead[-1][1])
        else:
            y, i = behind.pop()
            ahead.append((y + x, i))
    return [x for x, _ in behind], behind[0][1]


def merged_short(beats: DataFrame, least_ms: int = SHORT_MS) -> DataFrame:
    """(rec, i, rr_ms, t_ms) after merging short intervals, i from 0; the time axis is rebuilt from the first beat left where any were merged.

    Two long neighbours never lose or gain by what lies beyond the other: between them a
    recording is cut into islands, each of which is merged alone. A long interval among long
    ones is an island by itself and meets no Python; the others travel as one small array.
    """
    order = in_order()
    short = F.col("rr_ms") <= least_ms
    rows = beats.select("rec", "beat_idx", "rr_ms", "t_ms", short.alias("_short"))
    rows = rows.withColumns({"_b": F.coalesce(F.lag("_short").over(order), F.lit(False)), "_a": F.coalesce(F.lead("_short").over(order), F.lit(False))})
    cut = (~F.col("_short") & ~F.col("_b")).cast("long")
    # Lone intervals and islands both look at this table.
    rows = staged(rows.withColumn("_island", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0))), "islands")
    lone = ~F.col("_short") & ~F.col("_b") & ~F.col("_a")

    @F.pandas_udf("rr array<long>, head int")
    def merged(runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merged_run([int(v) for v in r], least_ms) for r in runs], columns=["rr", "head"])

    alone = rows.where(lone).select("rec", F.col("beat_idx").alias("_first"), F.lit(0).alias("_j"), "rr_ms", "t_ms", F.lit(0).alias("_lost"))
    some = rows.where(~lone).groupBy("rec", "_island").agg(F.sort_array(F.collect_list(F.struct("beat_idx", "rr_ms", "t_ms"))).alias("_run"))
    some = some.withColumn("_m", merged(F.transform("_run", lambda x: x["rr_ms"].cast("long"))))
    head = F.get("_run", F.col("_m.head"))["t_ms"]
    some = some.select("rec", F.col("_run")[0]["beat_idx"].alias("_first"), F.posexplode("_m.rr").alias("_j", "rr_ms"), head.alias("t_ms"), (F.size("_run") - F.size("_m.rr")).alias("_lost"))
    every = alone.unionByName(some)
    order = by_rec().orderBy("_first", "_j")
    upto = F.coalesce(F.sum("rr_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumns({"i": F.row_number().over(order) - 1, "_t": F.first("t_ms").over(order) + upto, "_any": F.max("_lost").over(by_rec())})
    return every.select("rec", F.col("i").cast("long").alias("i"), "rr_ms", F.when(F.col("_any") > 0, F.col("_t")).otherwise(F.col("t_ms")).alias("t_ms"))


def highpass(fs: float) -> np.ndarray:
    return K.sections(*K.butterworth(ORDER, CUTOFF, None, fs))


def _read_off(key: tuple, asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    """What one block of the grid gives to each point, by the line between two grid points."""
    start, y = joined(part)
    w = (asked["_p"] - asked["_k"]).to_numpy()
    x = np.zeros(len(asked))
    for place, weight in ((asked["_k"].to_numpy(), 1 - w), (asked["_next"].to_numpy(), w)):
        inside = (place >= start) & (place < start + len(y))
        x[inside] += y[place[inside] - start] * weight[inside]
    return pd.DataFrame({"rec": key[0], "i": asked["i"], "t": asked["t"], "x": x})


def detrended(series: DataFrame, design: Callable[[float], np.ndarray] = highpass, block: int = BLOCK) -> DataFrame:
    """(rec, i, x, t) without slow trends, from the same columns: i from 0, t in seconds and rising.

    The series is put on an even grid, at RATE or twice its own mean rate, by lines between its
    points; filtered there by blocks; and read off at its own times. Series whose grid is too
    short to filter lose a least-squares line over i instead.
    """
    least = padding(design(RATE))
    facts = series.groupBy("rec").agg(F.count("*").alias("_n"), F.min("t").alias("_t0"), (F.max("t") - F.min("t")).alias("_span"))
    fs = F.greatest(F.lit(RATE), F.col("_n") * 2 / F.when(F.col("_span") > 0, F.col("_span")))
    facts = facts.withColumn("_fs", fs).withColumn("_m", F.coalesce(F.floor(F.col("_span") * F.col("_fs")), F.lit(0)))
    facts = facts.withColumn("_step", F.col("_span") / F.greatest(F.col("_m") - 1, F.lit(1)))
    rows = series.select("rec", "i", "x", "t").join(facts, "rec")
    long = rows.where(F.col("_m") > least)
    order = by_rec().orderBy("i")
    line = long.withColumns({"_x1": F.lead("x").over(order), "_t1": F.lead("t").over(order), "_last": F.col("i") == F.col("_n") - 2}).where(F.col("_t1") > F.col("t"))
    place = lambda t: F.ceil((t - F.col("_t0")) / F.col("_step")).cast("long")
    low, high = place(F.col("t")), F.when(F.col("_last"), F.col("_m") - 1).otherwise(F.least(place(F.col("_t1")), F.col("_m")) - 1)
    line = line.where(low <= high).withColumn("_k", F.explode(F.sequence(low, high)))
    at = F.col("_t0") + F.col("_k") * F.col("_step")
    value = F.col("x") + (at - F.col("t")) * (F.col("_x1") - F.col("x")) / (F.col("_t1") - F.col("t"))
    at = block_of(F.col("_k"), F.col("_m"), block).alias("block")
    grid = line.select("rec", at, "_k", F.col("_m").alias("n"), F.col("_fs").alias("fs"), value.alias("x"))
    grid = grid.groupBy("rec", "block", F.col("n").cast("long").alias("n"), "fs").agg(F.sort_array(F.collect_list(F.struct("_k", "x"))).alias("s"))
    grid = grid.select("rec", "block", F.col("s")[0]["_k"].alias("i"), "n", "fs", F.transform("s", lambda v: v["x"]).alias("x"))
    done = zero_phase_blocks(grid, design)
    # Each point asks the block of its grid point, and that of the next one where it is another: what each block gives adds up.
    p = (F.col("t") - F.col("_t0")) / F.col("_step")
    asked = long.select("rec", "i", "t", p.alias("_p"), F.least(F.floor(p), F.col("_m") - 1).cast("long").alias("_k"), "_m").withColumn("_next", F.least(F.col("_k") + 1, F.col("_m") - 1))
    blocks = F.array_distinct(F.array(block_of(F.col("_k"), F.col("_m"), block), block_of(F.col("_next"), F.col("_m"), block)))
    asked = asked.select("rec", F.explode(blocks).alias("block"), "i", "t", "_p", "_k", "_next")
    read = asked.groupBy("rec", "block").cogroup(done.groupBy("rec", "block")).applyInPandas(_read_off, "rec long, i long, t double, x double")
    read = read.groupBy("rec", "i").agg(F.sum("x").alias("x"), F.max("t").alias("t")).select("rec", "i", "x", "t")
    brief = rows.where(F.col("_m") <= least)
    fit = brief.groupBy("rec").agg(F.regr_slope("x", "i").alias("_a"), F.avg("x").alias("_mx"), F.avg("i").alias("_mi"))
    flat = brief.join(fit, "rec").select("rec", "i", (F.col("x") - F.col("_mx") - F.coalesce("_a", F.lit(0.0)) * (F.col("i") - F.col("_mi"))).alias("x"), "t")
    return read.unionByName(flat)


def cleaned(beats: DataFrame, merge: bool = True, retime: bool = True, block: int = BLOCK) -> DataFrame:
    """(rec, i, x, t_s): the whole chain, in seconds; recordings of fewer than 4 intervals (after merging) give nothing."""
    if merge:
        beats = staged(merged_short(beats), "merged").withColumnRenamed("i", "beat_idx")
    else:
        beats = beats.withColumn("beat_idx", F.row_number().over(in_order()) - 1)
    rows = winsorised(beats, retime).withColumns({"_n": F.count("*").over(by_rec()), "_mean": F.avg("rr_w").over(by_rec())}).where("_n >= 4")
    # Its facts, its grid and what is read off it all look at this table.
    x = (F.col("rr_w") - F.col("_mean")) / 1000
    rows = staged(rows.select("rec", F.col("beat_idx").cast("long").alias("i"), x.alias("x"), (F.col("t_w") / 1000).alias("t")), "centred")
    return detrended(rows, block=block).select("rec", "i", "x", F.col("t").alias("t_s"))
