"""Permutations of samples without sorting: a keyed bijection tells where each sample goes.

Samples get dense numbers once. A permutation then is a Feistel network over the numbers
0 .. N - 1: number = left + a * right with left below a and right below b, a * b barely above
N; each round adds a keyed hash of one half to the other, which can be undone, so that different
numbers stay different. What falls on N or above goes through again until it is below (cycle
walking): it visits only numbers that are no sample's, of which there are fewer than a. So a
sample's place in any permutation is a few operations on its own row, and no permutation costs
an exchange. A hash depends on one half only, of which there are about the square root of N, so
that a block of samples reads it from a small table (``places``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, CELLS = 6, 4096
#: (half, permutation, round) -> a whole number, not negative, by plain arithmetic, which columns and arrays share.
Hash = Callable
_PRIME = (1 << 31) - 1


def keyed(seed: int) -> Hash:
    """Squares modulo a prime, twice over a line in all that it depends on."""
    def of(half, perm, turn):
        x = (half * 48271 + (perm + 1) * 69621 + turn * 15485863 + seed % _PRIME) % _PRIME
        x = (x * x + (perm + 1) * 16807 + turn) % _PRIME
        return (x * x + half) % _PRIME

    return of


def numbered(rows: DataFrame, key: str, name: str = "no", cell: Column | None = None) -> DataFrame:
    """``rows`` with dense numbers from 0, by cells of the key and within a cell by the key; keys differ.

    Only the sizes of the CELLS cells meet in one task.
    """
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(CELLS)) if cell is None else cell)
    ahead = F.sum("n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("n")).select("_cell", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    return rows.withColumn("_place", place).join(F.broadcast(sizes), "_cell").withColumn(name, F.col("_ahead") + F.col("_place")).drop("_cell", "_ahead", "_place")


def placed(rows: DataFrame, no: str, perm: str, total: str, name: str = "place", hashed: Hash | None = None) -> DataFrame:
    """``rows`` with the place of number ``no``, of ``total``, in permutation ``perm``: a bijection of 0 .. total - 1 for each."""
    hashed = hashed or keyed(42)
    p, n = F.col(perm), F.col(total)
    a = F.ceil(F.sqrt(n)).cast("long")
    t = rows.withColumn("_a", a).withColumn("_b", F.ceil(n / F.col("_a")).cast("long"))
    t = t.withColumns({"_l": F.col(no) % F.col("_a"), "_r": F.expr(f"{no} div _a")})
    for turn in range(1, ROUNDS + 1):
        base = F.col("_a") if turn % 2 else F.col("_b")
        t = t.withColumns({"_l": F.col("_r"), "_r": (F.col("_l") + hashed(F.col("_r"), p, F.lit(turn))) % base})
    once = F.col("_a") * F.col("_r") + F.col("_l")

    def again(v: Column) -> Column:
        def turned(s: Column, turn: Column) -> Column:
            base = F.when(turn % 2 == 1, F.col("_a")).otherwise(F.col("_b"))
            return F.struct(s["r"].alias("l"), ((s["l"] + hashed(s["r"], p, turn)) % base).alias("r"))

        halves = F.struct((v % F.col("_a")).alias("l"), F.floor(v / F.col("_a")).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turned, lambda s: F.col("_a") * s["r"] + s["l"])

    walked = F.aggregate(F.sequence(F.lit(1), F.col("_a").cast("int")), F.col(name), lambda v, _: F.when(v >= n, again(v)).otherwise(v))
    t = t.withColumn(name, once)
    return t.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked)).drop("_a", "_b", "_l", "_r")


def places(no: np.ndarray, perm: int, total: int, hashed: Hash, halves: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """What :func:`placed` tells, for an array of numbers: hashes are formed once for each half, and read off.

    halves: (no % a, no // a) of :func:`halved`, where several permutations take the same numbers.
    """
    a = math.ceil(math.sqrt(total))
    b = math.ceil(total / a)
    rounds = []
    for turn in range(1, ROUNDS + 1):
        base, size = (a, b) if turn % 2 else (b, a)
        rounds.append((np.uint32(base), (hashed(np.arange(size, dtype=np.int64), perm, turn) % base).astype(np.uint32)))

    def once(left: np.ndarray, r: np.ndarray) -> np.ndarray:
        for base, shift in rounds:
            new = shift.take(r)
            new += left
            np.minimum(new, new - base, out=new)  # less than base: the difference has wrapped around
            left, r = r, new
        return r.astype(np.int64) * a + left

    out = once(*(halves or halved(no, total)))
    far = np.flatnonzero(out >= total)
    while len(far):  # there are fewer such numbers than a
        out[far] = once(*halved(out[far], total))
        far = far[out[far] >= total]
    return out


def halved(no: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves that the rounds start from."""
    r, left = np.divmod(no, math.ceil(math.sqrt(total)))
    return left.astype(np.uint32), r.astype(np.uint32)
