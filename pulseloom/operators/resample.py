"""Series on an even grid: each interval between two beats gives the grid points that lie in it.

Slopes at the knots decide on the curve. Those of the monotone (pchip) and of Akima's
interpolation look at two neighbours on each side, so that they come from lags and leads;
linear interpolation needs none. Those of the not-a-knot cubic spline solve a tridiagonal
system over the whole series: it is solved by blocks of knots with a halo on each side. A
row of that system outweighs its neighbours by two to one, so that what is unknown beyond
the halo reaches the block shrunk by half at each knot: by 2^-HALO in all, which is below the
rounding of doubles. No task holds a recording.

Times and values are whole milliseconds; grid points are ``step_ms`` apart, from the first
beat on, the last beat excluded. Of beats with the same time the first counts; series of
fewer than two beats give nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K

#: Knots of a block, and of the halo on each side of it.
BLOCK, HALO = 4096, 64
METHODS = ("linear", "pchip", "akima", "cubic")


def knots(beats: DataFrame) -> DataFrame:
    """(rec, i, t, y, t0, h, m): beats in order of time, numbered from 0, with width and slope of the interval that follows; null after the last."""
    order = Window.partitionBy("rec").orderBy("t_ms", "beat_idx")
    rows = beats.select("rec", "beat_idx", "t_ms", F.col("rr_ms").alias("y"), F.lag("t_ms").over(order).alias("_before"))
    rows = rows.where(F.col("_before").isNull() | (F.col("_before") < F.col("t_ms")))
    w = Window.partitionBy("rec").orderBy("t_ms")
    h, rise = F.lead("t_ms").over(w) - F.col("t_ms"), F.lead("y").over(w) - F.col("y")
    return rows.select(
        "rec", (F.row_number().over(w) - 1).alias("i"), F.col("t_ms").alias("t"), "y", F.first("t_ms").over(w).alias("t0"), h.alias("h"), (rise / h).alias("m"),
    )


def _around(k: DataFrame) -> DataFrame:
    """``k`` with slopes and widths of the intervals before (b1, b2) and after (a1) the one that follows a knot, and what is left to the end."""
    w = Window.partitionBy("rec").orderBy("i")
    lag, lead = (lambda c, n=1: F.lag(c, n).over(w)), (lambda c, n=1: F.lead(c, n).over(w))
    return k.withColumns({"mb1": lag("m"), "mb2": lag("m", 2), "hb1": lag("h"), "hb2": lag("h", 2), "ma1": lead("m"), "ha1": lead("h")})


def pchip(k: DataFrame) -> DataFrame:
    """``k`` with d: slopes of the monotone cubic of Fritsch and Carlson, by weighted harmonic means."""
    def edge(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        e = ((h0 * 2 + h1) * m0 - h0 * m1) / (h0 + h1)
        return F.when(e * m0 <= 0, 0.0).when((m0 * m1 < 0) & (F.abs(e) > F.abs(m0) * 3), m0 * 3).otherwise(e)

    m, b, h, hb = F.col("m"), F.col("mb1"), F.col("h"), F.col("hb1")
    w1, w2 = h * 2 + hb, h + hb * 2
    inner = F.when(b * m > 0, (w1 + w2) / (w1 / b + w2 / m)).otherwise(0.0)
    first = F.when(F.col("ma1").isNull(), m).otherwise(edge(h, F.col("ha1"), m, F.col("ma1")))
    last = F.when(F.col("mb2").isNull(), b).otherwise(edge(hb, F.col("hb2"), b, F.col("mb2")))
    return _around(k).withColumn("d", F.when(b.isNull(), first).when(m.isNull(), last).otherwise(inner))


def akima(k: DataFrame) -> DataFrame:
    """``k`` with d: slopes of Akima's interpolation, with two segments extrapolated on each side.

    Where both weights are below 1e-9 of the largest of the series, the mean of the two slopes counts.
    """
    rows = _around(k).withColumn("alone", F.col("mb1").isNull() & F.col("ma1").isNull() | F.col("m").isNull() & F.col("mb2").isNull())
    m, b1, b2, a1 = (F.col(c) for c in ("m", "mb1", "mb2", "ma1"))
    after = F.coalesce(m, b1 * 2 - b2)  # the segment after the last knot
    before = F.coalesce(b1, m * 2 - a1)
    after2 = F.when(m.isNull(), b1 * 3 - b2 * 2).otherwise(F.coalesce(a1, m * 2 - b1))
    before2 = F.when(b1.isNull(), m * 3 - a1 * 2).otherwise(F.coalesce(b2, b1 * 2 - m))
    rows = rows.withColumns({"p": before, "q": after, "w1": F.abs(after2 - after), "w2": F.abs(before - before2)})
    rows = rows.withColumn("top", F.max(F.col("w1") + F.col("w2")).over(Window.partitionBy("rec")))
    total = F.col("w1") + F.col("w2")
    mean, weighted = (F.col("p") + F.col("q")) / 2, (F.col("w1") * F.col("p") + F.col("w2") * F.col("q")) / total
    return rows.withColumn("d", F.when(F.col("alone"), F.coalesce(m, b1)).when(total <= F.col("top") * 1e-9, mean).otherwise(weighted))


def cubic(k: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """``k`` with d: slopes of the not-a-knot cubic spline, block by block."""
    n = F.col("i")
    low, high = F.floor((n - halo) / block), F.floor((n + halo) / block)
    rows = k.withColumn("block", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), high.cast("int"))))

    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        own = part["i"].to_numpy() // block == key[1]
        if not own.any() or len(part) < 2:
            return part.iloc[:0].assign(d=0.0)
        # An end that the halo cuts is treated as an end of the series; what that changes has faded within the halo.
        d = K.cubic_slopes(part["t"].to_numpy(float), part["y"].to_numpy(float))
        return part.assign(d=d)[own]

    fields = "rec long, i int, t long, y double, t0 long, h long, m double, block int, d double"
    rows = rows.withColumn("y", F.col("y").cast("double"))
    return rows.groupBy("rec", "block").applyInPandas(of, fields).drop("block")


SLOPES = {"pchip": pchip, "akima": akima, "cubic": cubic}


def resampled(beats: DataFrame, step_ms: int = 250, method: str = "cubic") -> DataFrame:
    """(rec, i, x, t_s): values in seconds on the even grid, by the curve through the beats (rec, beat_idx, rr_ms, t_ms)."""
    if method not in METHODS:
        raise ValueError(f"unknown interpolation: {method}")
    k = knots(beats)
    w = Window.partitionBy("rec").orderBy("i")
    if method != "linear":
        k = SLOPES[method](k).select("rec", "i", "t", "y", "t0", "h", "d")
        k = k.withColumn("d1", F.lead("d").over(w))
    k = k.withColumn("y1", F.lead("y").over(w)).where(F.col("h").isNotNull())
    place = lambda t: F.ceil((t - F.col("t0")) / step_ms).cast("long")
    low, high = place(F.col("t")), place(F.col("t") + F.col("h")) - 1
    g = k.where(low <= high).withColumn("j", F.explode(F.sequence(low, high)))
    at = F.col("t0") + F.col("j") * step_ms
    h, y, y1 = F.col("h"), F.col("y"), F.col("y1")
    if method == "linear":
        # One quotient of whole numbers: the nearest double to the true value.
        x = (y * h + (at - F.col("t")) * (y1 - y)) / (h * 1000)
    else:
        u, d, d1 = (at - F.col("t")) / h, F.col("d"), F.col("d1")
        v = F.lit(1.0) - u
        x = ((u * 2 + 1) * v * v * y + u * v * v * h * d + u * u * (F.lit(3.0) - u * 2) * y1 + u * u * (u - 1) * h * d1) / 1000
    return g.select("rec", F.col("j").alias("i"), x.alias("x"), (at / 1000).alias("t_s"))
