"""R-peaks of long signals by blocks.

A block tells its count, mean and spread, and all maxima that lie inside of it with their
heights. A maximum may be a plateau that runs over the border of two blocks: of its first and
its last run of equal values a block tells value, extent and neighbour, and a row a block is
enough to put these together. Mean and deviation of the recording then say which maxima are
high enough. Of two that are nearer than the refractory time the higher stays: that couples only
maxima in an unbroken chain of such neighbours, and each chain is settled alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K
from pulseloom.operators.filters import BLOCK, cut, joined, padding, zero_phase_blocks

#: Band in Hz and order of the filter; height in deviations; refractory time in seconds.
LOW, HIGH, ORDER, HEIGHT, APART_S = 0.5, 40.0, 4, 0.5, 0.3
#: Deviation up to which a signal counts as flat: what rounding leaves of a constant.
FLAT = 1e-12


def bandpass(fs: float) -> np.ndarray:
    return K.sections(*K.butterworth(ORDER, LOW, HIGH, fs))


_RUN = "struct<value: double, start: long, end: long, neighbour: double>"
_TOLD = f"block int, n long, mean double, spread double, pos array<long>, height array<double>, first {_RUN}, last {_RUN}, whole boolean"


def _told(key: str):
    def of(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start, x = joined(part)
        change = np.flatnonzero(np.diff(x) != 0)
        starts, ends = np.append(0, change + 1), np.append(change, len(x) - 1)
        inside = K.local_maxima(x)
        run = lambda r, beside: {"value": float(x[starts[r]]), "start": int(start + starts[r]), "end": int(start + ends[r]), "neighbour": None if beside is None else float(x[starts[beside]])}
        one = len(starts) == 1
        row = (k[0], k[1], len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()), inside + start, x[inside], run(0, None if one else 1), run(-1, None if one else -2), one)
        return pd.DataFrame([row], columns=[key, "block", "n", "mean", "spread", "pos", "height", "first", "last", "whole"])

    return of


def _across(key: str):
    def of(k: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        """Maxima among the runs at the borders of blocks, put together where they go on."""
        runs: list[list] = []  # value, start, end, neighbour before, neighbour after
        for first, last, whole in blocks.sort_values("block")[["first", "last", "whole"]].itertuples(index=False):
            new = [[first["value"], first["start"], first["end"], None, first["neighbour"]]]
            if not whole:
                new.append([last["value"], last["start"], last["end"], last["neighbour"], None])
            if runs and runs[-1][0] == new[0][0]:
                runs[-1][2], runs[-1][4] = new[0][2], new[0][4]
                new = new[1:]
            runs += new
        out = []
        for i, (value, start, end, before, after) in enumerate(runs):
            before = before if before is not None else runs[i - 1][0] if i else None
            after = after if after is not None else runs[i + 1][0] if i + 1 < len(runs) else None
            if before is not None and after is not None and value > max(before, after):
                out.append((k[0], (start + end) // 2, value))
        return pd.DataFrame(out, columns=[key, "pos", "height"])

    return of


def maxima(blocks: DataFrame, keys: str) -> tuple[DataFrame, DataFrame]:
    """((key, pos, height) of all strict maxima, the middle of a plateau; (key, mean, sd)) of blocks as of :func:`filters.cut`."""
    key = keys.split()[0]
    told = blocks.groupBy(key, "block").applyInPandas(_told(key), f"{keys}, {_TOLD}")
    told = told.repartition(key, "block")  # one exchange of what is told serves all three uses
    s = told.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("spread") + F.col("n") * F.col("mean") * F.col("mean")).alias("square"))
    facts = s.select(key, "mean", F.sqrt(F.greatest(F.col("square") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))
    inside = told.select(key, F.explode(F.arrays_zip("pos", "height")).alias("p")).select(key, "p.pos", "p.height")
    across = told.select(key, "block", "first", "last", "whole").groupBy(key).applyInPandas(_across(key), f"{keys}, pos long, height double")
    return inside.unionByName(across), facts


def apart(found: DataFrame, key: str, distance: int) -> DataFrame:
    """(key, pos): of maxima (key, pos, height) nearer than ``distance`` the higher stays, the later on ties, highest first."""
    order = Window.partitionBy(key).orderBy("pos")
    near = F.coalesce(F.col("pos") - F.lag("pos").over(order) < distance, F.lit(False))
    rows = found.withColumn("_near", near)
    rows = rows.withColumns({"_chain": F.sum((~F.col("_near")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.coalesce(F.lead("_near").over(order), F.lit(False))})
    alone = ~F.col("_near") & ~F.col("_next")

    @F.pandas_udf("array<long>")
    def settled(pos: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([K.highest_apart(np.asarray(p), np.asarray(h), distance).tolist() for p, h in zip(pos, height, strict=True)])

    chains = rows.where(~alone).groupBy(key, "_chain").agg(F.sort_array(F.collect_list(F.struct("pos", "height"))).alias("c"))
    kept = chains.select(key, F.explode(settled(F.col("c.pos"), F.col("c.height"))).alias("pos"))
    return rows.where(alone).select(key, "pos").unionByName(kept)


def r_peaks(pieces: DataFrame, fs: float, keys: str = "recording_id string", block: int = BLOCK) -> DataFrame:
    """(key, beat_idx, sample) of signals given as pieces (key, i, n, x) at the rate ``fs``.

    Band-pass, maxima of at least half a deviation above the mean, 0.3 s apart. Signals too
    short to filter, and flat ones, have none.
    """
    key = keys.split()[0]
    rows = pieces.where(F.col("n") > padding(bandpass(fs))).withColumn("fs", F.lit(float(fs)))
    found, facts = maxima(zero_phase_blocks(cut(rows, key, block), bandpass, keys), keys)
    high = found.join(facts, key).where((F.col("sd") > FLAT) & ((F.col("height") - F.col("mean")) / F.col("sd") >= HEIGHT))
    at = apart(high.select(key, "pos", "height"), key, int(APART_S * fs))
    return at.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long").alias("beat_idx"), F.col("pos").alias("sample"))
