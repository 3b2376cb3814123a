"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate q, at most MOST, that stays as close to 1 as possible in relative
entropy, sum(q ln q - q + 1), while the words of each source, sum(size * q), meet the
source's target. The dual of that convex problem has one variable for each source, and its
solution tilts exponentially: q = min(MOST, exp(lambda * size)). A source that has to grow
repeats its long documents first, one that has to shrink lets go of them first, by as
little as its target allows.

Newton's method solves the dual. Gradient and curvature are sums over documents, which a
table of (source, size, number of documents) holds in far fewer rows; each step joins it
with the multipliers and aggregates by source, with sums formed before the exchange. A
step that would leave the interval known to hold the root halves that instead. Steps end
once all sources are within TOLERANCE of their targets.

Rates become copies in whole numbers. All decisions fall on the table of (source, size):
going down from the largest size, the copies up to a size are the whole part of the rates
up to it, so that each size has its rate to within one copy and words fall short by less
than one document; these go, largest size first, to sizes that fit. Within a size, copies
are dealt evenly over blocks of documents, and evenly over the documents of a block in
order of a hash, so that no task holds more than a block's share of a hot size.

Rates count in billionths, and whole numbers decide, so that reruns agree.

Defined results: documents without words take 0 words (and keep their one copy); a null
source is a source of its own, last in order; without any words all targets are 0; very long texts
are counted whole. Rows
with the same doc_id and size are alike, and which of them is copied does not matter.
Columns of the input that have the output column's name are replaced by it. Targets are
told in one task that holds a row for each source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import discard, n_words, staged, table

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Sources whose targets may be broadcast; beyond that they are joined by shuffling.
BROADCAST_SOURCES = 10_000
NEWTON_STEPS, TOLERANCE, FILL_ROUNDS, BLOCKS = 80, 1e-9, 6, 512
#: Rates count in these.
UNIT = 1_000_000_000


def rate(tilt: Column, size: Column, most: float = MOST) -> Column:
    """min(most, exp(lambda * size))."""
    return F.when(tilt * size >= math.log(most), F.lit(float(most))).otherwise(F.exp(tilt * size))


def small(df: DataFrame) -> DataFrame:
    """A staged table with a row for each source, to be broadcast where these are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def newton(sizes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(key, tilt): the multiplier of each source, so that sum(n * size * rate) is its target.

    sizes: (key, size, n); goals: (key, source_size, target) with targets up to most * source_size.
    """
    worded = sizes.where("size > 0 AND n > 0")
    facts = worded.groupBy("key").agg(F.min("size").alias("least"), F.sum(F.col("size") * F.col("n")).cast("double").alias("total"))
    top = F.lit(math.log(most)) / F.col("least")  # where all rates are at their most
    full = F.col("target") >= F.col("total") * most * (1 - 1e-12)
    # Below, exp(lambda * least) alone bounds the sum.
    bottom = F.when(F.col("target") > 0, F.least(F.lit(0.0), F.ln(F.col("target") / F.col("total")) / F.col("least"))).otherwise(-1e9)
    at = goals.join(facts, "key").select(
        "key", "target", F.when(F.col("target") > F.col("total"), 0.0).otherwise(bottom).alias("low"), top.alias("high"),
        F.when(full, top).when(F.col("target") <= 0, -1e9).otherwise(0.0).alias("tilt"), (full | (F.col("target") <= 0)).alias("done"),
    )
    at = staged(at, "mix-tilts")
    for _ in range(NEWTON_STEPS):
        if at.where("NOT done").isEmpty():
            break
        mass = F.col("n") * F.col("size") * rate(F.col("tilt"), F.col("size"), most)
        bends = F.when(F.col("tilt") * F.col("size") < math.log(most), mass * F.col("size")).otherwise(0.0)
        state = [F.max(c).alias(c) for c in ("target", "low", "high", "tilt", "done")]
        sums = worded.join(small(at), "key").groupBy("key").agg(*state, F.sum(mass).alias("got"), F.sum(bends).alias("bend"))
        off = F.col("got") - F.col("target")
        sums = sums.withColumns({"low": F.when(off <= 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(off >= 0, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.try_divide(off, F.col("bend"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        done = F.col("done") | (F.abs(off) <= F.col("target") * TOLERANCE)
        turned = F.when(done, F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        before, at = at, staged(sums.select("key", "target", "low", "high", turned.alias("tilt"), done.alias("done")), "mix-tilts")
        discard(before)
    return at.select("key", "tilt")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    Targets are the smaller of most * source_size and weight * level; the level is where
    they share ``share`` of all words, which is where repeated resharing ends. One row
    for each source is all that meets in a task.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "left": F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)),
    })
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("left") / F.col("w_left"), F.struct(-F.col("cap") / F.col("w"), (F.col("left") / F.col("w_left")).alias("level")))).over(everything)["level"]
    return by.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap")).alias("target"))


def copies_by_size(sizes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, source_size, target, rate, copies): copies of all n documents of a size together."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    goals = staged(goals.select(key, "source_size", "target"), "mix-goals")
    sizes = staged(sizes.select(key, "source", "size", "n"), "mix-sizes")
    tilts = staged(goals.join(newton(sizes, goals, most), "key", "left"), "mix-tilts")
    t = sizes.join(small(tilts), "key")
    billionths = F.when(F.col("size") > 0, F.round(rate(F.col("tilt"), F.col("size"), most) * UNIT)).otherwise(UNIT).cast("decimal(20,0)")
    t = t.withColumn("_billionths", billionths)
    room = F.col("n") * most
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum((F.col("_billionths") * F.col("n")).cast("decimal(38,0)")).over(down)
    # The nudge of a millionth keeps a sum like 6.9999999 from losing a copy.
    t = t.withColumn("_upto", F.floor((upto + UNIT // 1_000_000) / UNIT).cast("long"))
    t = t.withColumn("copies", F.col("_upto") - F.coalesce(F.lag("_upto").over(Window.partitionBy("source").orderBy(F.col("size").desc())), F.lit(0)))
    t = t.select("source", "size", "n", "source_size", "target", (F.col("_billionths").cast("double") / UNIT).alias("rate"), F.least(room, "copies").alias("copies"))
    whole = Window.partitionBy("source")
    down = whole.orderBy(F.col("size").desc())
    taken = lambda: F.sum(F.col("size") * F.col("copies")).over(whole)
    for _ in range(FILL_ROUNDS):
        t = t.withColumn("missing", F.col("target") - taken())
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (F.col("copies") < room)
        # As many whole copies as fit of one size, or one copy of each of several sizes.
        t = t.withColumn("cost", F.when(fits, F.col("size")).otherwise(0))
        t = t.withColumn("spent", F.sum("cost").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        t = t.withColumn("copies", F.col("copies") + (fits & (F.col("spent") <= F.col("missing"))).cast("long"))
    # What is left is less than most sizes: the smallest fitting size takes it up at once.
    t = t.withColumn("missing", F.col("target") - taken())
    able = F.when((F.col("size") > 0) & (F.col("copies") < room), F.col("size"))
    t = t.withColumn("least", F.min(able).over(whole))
    more = F.least(room - F.col("copies"), F.round(F.col("missing") / F.col("size")).cast("long"))
    t = t.withColumn("copies", F.col("copies") + F.when((F.col("size") == F.col("least")) & (F.col("missing") > 0), F.greatest(F.lit(0), more)).otherwise(0))
    return t.select("source", "size", "n", "source_size", "target", "rate", F.col("copies").cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, size: Column | None = None, column: str = "mix") -> DataFrame:
    """``docs`` with struct ``column``: size, source_size, target, rate, copies.

    size: the words of a document; counted from ``text`` where none is given.
    """
    size = n_words("text") if size is None else size
    # A source as a key that is never null, so that the window and the join below share one exchange.
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", key.alias("_key"), size.alias("_size")).withColumn("_block", F.pmod(F.xxhash64("doc_id", "_size"), F.lit(BLOCKS)))
    blocks = staged(rows.groupBy("_key", "_size", "_block").agg(F.count("*").alias("_n")), "mix-blocks")
    source = F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30)).alias("source")
    sizes = blocks.groupBy(source, F.col("_size").alias("size")).agg(F.sum("_n").alias("n"))
    plan = copies_by_size(sizes, targets(sizes, weights, share, most), most)
    plan = plan.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumnsRenamed({"size": "_size", "n": "_all"})
    # Even shares of a size's copies for its blocks, by whole numbers.
    upto = Window.partitionBy("_key", "_size").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    dealt = blocks.withColumn("_upto", F.sum("_n").over(upto)).join(plan.drop("source"), ["_key", "_size"])
    share_of = lambda n: F.expr(f"(({n}) * copies) div _all")
    dealt = staged(
        dealt.select(
            "_key", "_size", "_block", "_n", (share_of("_upto") - share_of("_upto - _n")).alias("_copies"),
            F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"),
        ),
        "mix-dealt",
    )
    discard(blocks)
    place = F.row_number().over(Window.partitionBy("_key", "_size", "_block").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # A merge join: the table grows with the input, and its compressed size would pass for a small one.
    out = rows.withColumn("_place", place).join(dealt.hint("merge"), ["_key", "_size", "_block"])
    copies = F.expr("(_place * _copies) div _n - ((_place - 1) * _copies) div _n")
    mix = F.struct(
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_rate").alias("rate"), copies.alias("copies"),
    )
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != column], mix.alias(column))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see the module for nulls."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", n_words("text").alias("words"))
    docs = staged(docs, "mix-sizes")  # the texts are read once
    return mixed(docs, size=F.col("words")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )
