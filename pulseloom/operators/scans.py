"""Running sums over values, without one task that sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells that the values of one key are cut into.
CELLS, CHUNK = 256, 16


def before(rows: DataFrame, keys: Sequence[str], value: str, amount: str, cells: int = CELLS) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same keys whose ``value`` is smaller.

    Values are numbers, not null, and differ within a key. Cells come from approximate
    quantiles, so that each holds about the same number of rows: their totals are few,
    and sorting goes on inside of cells. How well they divide the rows decides on balance
    only, never on the result.
    """
    keys = list(keys)
    shares = [i / cells for i in range(1, cells)]
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 4 * cells)).alias("_cuts"))
    # The last cut of each chunk, so that a value is compared with these and one chunk only.
    lasts = F.transform(F.sequence(F.lit(0), F.floor(F.size("_cuts") / CHUNK).cast("int")), lambda i: F.get("_cuts", i * CHUNK + CHUNK - 1))
    cuts = cuts.withColumn("_lasts", F.filter(lasts, lambda c: c.isNotNull()))
    placed = rows.join(cuts, keys) if keys else rows.crossJoin(F.broadcast(cuts))
    chunk = F.size(F.filter("_lasts", lambda c: c <= F.col(value)))
    placed = placed.withColumn("_chunk", chunk)
    inner = F.size(F.filter(F.slice("_cuts", F.col("_chunk") * CHUNK + 1, F.lit(CHUNK)), lambda c: c <= F.col(value)))
    placed = placed.withColumn("_cell", F.col("_chunk") * CHUNK + inner).drop("_cuts", "_lasts", "_chunk")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = placed.groupBy(*keys, "_cell").agg(F.sum(amount).alias("_total"))
    ahead = F.coalesce(F.sum("_total").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_cell", ahead.alias("_ahead"))  # at most ``cells`` rows for each key
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(totals, [*keys, "_cell"])
    return out.withColumn("before", F.col("_ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_cell", "_ahead")
