"""Zero-phase filtering of long series by blocks, with states that are passed on.

A cascade of second-order sections is a linear system: over a block of n samples, its state at
the end is M^n times its state at the start, plus what the block alone leaves when it starts
from zero. So all blocks are run from zero at once; the states at their starts follow block by
block from these few numbers (a row a block); and all blocks are run again from their true
starts. Forward, then backward in the same way. Each block is a group of its own, one row with
an array: a task never holds more of a recording, recordings of any length spread over all
tasks, and samples are shuffled as arrays, twice in all.

Ends are extended oddly, and states settled at the first value, as zero-phase filtering has it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K

#: Samples of a block. The last one of a series takes in what is left, and has up to twice as many.
BLOCK = 1 << 15
#: Sampling rate -> second-order sections.
Design = Callable[[float], np.ndarray]


def padding(sos: np.ndarray) -> int:
    """Samples by which each end is extended."""
    return 3 * (2 * len(sos) + 1)


def block_of(i: Column, n: Column, block: int) -> Column:
    """The block of sample i of n."""
    return F.least(F.floor(i / block), F.greatest(F.floor(n / block), F.lit(1)) - 1).cast("int")


def cut(pieces: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, block, i, n, fs, x): pieces (key, i, n, fs, x) of a series, x an array from sample i on, cut where blocks meet."""
    first, last = block_of(F.col("i"), F.col("n"), block), block_of(F.col("i") + F.size("x") - 1, F.col("n"), block)
    rows = pieces.where(F.size("x") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block").cast("long") * block, F.col("i"))
    # The last block has no end of its own.
    end = F.when(F.col("block") == block_of(F.col("n") - 1, F.col("n"), block), F.col("n")).otherwise((F.col("block") + 1).cast("long") * block)
    end = F.least(end, F.col("i") + F.size("x"))
    x = F.slice("x", (start - F.col("i") + 1).cast("int"), (end - start).cast("int"))
    return rows.select(key, "block", start.alias("i"), F.col("n").cast("long").alias("n"), F.col("fs").cast("double").alias("fs"), x.cast("array<double>").alias("x"))


def zero_phase_blocks(blocks: DataFrame, design: Design, keys: str = "rec long") -> DataFrame:
    """(key, block, i, n, fs, x), a row a block, filtered forward and backward, from pieces as :func:`cut` gives them.

    keys: name and type of the key. Series need more samples than the padding; so do blocks.
    """
    there = _one_way(blocks, design, keys, backward=False)
    return _one_way(there, design, keys, backward=True)


def zero_phase(samples: DataFrame, design: Design, keys: str = "rec long", block: int = BLOCK) -> DataFrame:
    """(key, i, x) filtered forward and backward, from rows (key, i, n, fs, x): i from 0 to n - 1, all there, n above the padding."""
    key = keys.split()[0]
    at = block_of(F.col("i"), F.col("n"), block).alias("block")
    rows = samples.groupBy(key, at, F.col("n").cast("long").alias("n"), F.col("fs").cast("double").alias("fs"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")))).alias("s"))
    rows = rows.select(key, "block", F.col("s")[0]["i"].alias("i"), "n", "fs", F.transform("s", lambda v: v["x"]).alias("x"))
    done = zero_phase_blocks(rows, design, keys)
    return done.select(key, "i", F.posexplode("x").alias("_p", "x")).select(key, (F.col("i") + F.col("_p")).alias("i"), "x")


def joined(part: pd.DataFrame) -> tuple[int, np.ndarray]:
    """(number of the first sample, values) of the pieces of one block."""
    part = part.sort_values("i")
    return int(part["i"].iloc[0]), np.concatenate([np.asarray(x, float) for x in part["x"]])


def _laid_out(part: pd.DataFrame, sos: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of a block in the order of the run; forward, the extensions of both ends are added."""
    (first, x), n, pad = joined(part), int(part["n"].iloc[0]), padding(sos)
    i = first + np.arange(len(x))
    if backward:
        return i[::-1], x[::-1]
    ends = 2 * x[0] - x[pad:0:-1], 2 * x[-1] - x[-2 : -pad - 2 : -1]
    if i[0] == 0:
        x, i = np.concatenate([ends[0], x]), np.concatenate([np.arange(-pad, 0), i])
    if i[-1] == n - 1:
        x, i = np.concatenate([x, ends[1]]), np.concatenate([i, np.arange(n, n + pad)])
    return i, x


def _one_way(rows: DataFrame, design: Design, keys: str, backward: bool) -> DataFrame:
    key = keys.split()[0]
    # Both uses of the dealt rows read one exchange.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "block")

    def alone(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """What a block leaves; the first one starts from its settled state, all others from zero."""
        fs, n = float(part["fs"].iloc[0]), int(part["n"].iloc[0])
        sos = design(fs)
        i, x = _laid_out(part, sos, backward)
        first = i[0] >= n if backward else i[0] < 0
        state = K.settled(sos) * x[0] if first else np.zeros(2 * len(sos))
        return pd.DataFrame({key: [k[0]], "block": [k[1]], "size": [len(x)], "fs": [fs], "state": [K.cascaded(x, sos, state)[1]]})

    def passed_on(k: tuple, ends: pd.DataFrame) -> pd.DataFrame:
        """The state at the start of each block but the first."""
        ends = ends.sort_values("block", ascending=not backward)
        step = K.free_step(design(float(ends["fs"].iloc[0])))
        out, state, powers = [], None, {}
        for b, size, left in zip(ends["block"], ends["size"], ends["state"], strict=True):
            if state is None:
                state = np.asarray(left)
                continue
            out.append((k[0], b, state))
            if size not in powers:
                powers[size] = np.linalg.matrix_power(step, int(size))
            state = powers[size] @ state + np.asarray(left)
        return pd.DataFrame(out, columns=[key, "block", "state"])

    def run(k: tuple, part: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        names = [key, "block", "i", "n", "fs", "x"]
        if not len(part):
            return pd.DataFrame(columns=names)
        fs, n = float(part["fs"].iloc[0]), int(part["n"].iloc[0])
        sos = design(fs)
        i, x = _laid_out(part, sos, backward)
        state = np.asarray(starts["state"].iloc[0]) if len(starts) else K.settled(sos) * x[0]
        y = K.cascaded(x, sos, state)[0]
        if backward:
            i, y = i[::-1], y[::-1]
        keep = i < n if backward else i >= 0  # the way back begins in the extension of the far end
        return pd.DataFrame([(k[0], k[1], int(i[keep][0]), n, fs, y[keep])], columns=names)

    ends = rows.groupBy(key, "block").applyInPandas(alone, f"{keys}, block int, size long, fs double, state array<double>")
    starts = ends.groupBy(key).applyInPandas(passed_on, f"{keys}, block int, state array<double>")
    return rows.groupBy(key, "block").cogroup(starts.groupBy(key, "block")).applyInPandas(run, f"{keys}, block int, i long, n long, fs double, x array<double>")
