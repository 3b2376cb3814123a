"""Group statistics over long tables (sample_id, grp, feature, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.permutations import Hash, halved, keyed, numbered, places
from pulseloom.operators.scans import before
from pulseloom.sources.store import staged

#: Abramowitz and Stegun 7.1.26 is too coarse here; this rational form of erfc has a relative error under 1.2e-7: fixed values.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0."""
    t = 1 / (1 + x / 2)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def prepared(long: DataFrame, least_variance: float = 1e-9) -> DataFrame:
    """Features with values only, means for missing ones, without near-constant ones, standardised (ddof 0).

    Mean and variance come from one aggregation by feature: a missing value that becomes the
    mean leaves the mean as it is, and spreads the variance over all rows.
    """
    v = F.col("value")
    m = long.groupBy("feature").agg(F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(v) / F.count("*")).alias("_var")).where(F.col("_var") > least_variance)
    rows = long.join(m, "feature")
    return rows.select("sample_id", "grp", "feature", ((F.coalesce("value", "_mean") - F.col("_mean")) / F.sqrt("_var")).alias("value"))


def effect_size(long: DataFrame, a, b) -> DataFrame:
    """(feature, mean_a, mean_b, effect_size): difference of means over the root of the mean population variance."""
    g = lambda f, x: f(F.when(F.col("grp") == x, F.col("value")))
    m = long.groupBy("feature").agg(g(F.avg, a).alias("mean_a"), g(F.avg, b).alias("mean_b"), g(F.var_pop, a).alias("va"), g(F.var_pop, b).alias("vb"))
    d = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return m.select("feature", "mean_a", "mean_b", F.when(d > 0, (F.col("mean_a") - F.col("mean_b")) / d).otherwise(0.0).alias("effect_size"))


def ranked(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` (keys, value, n) with ``rank``: the average rank of the n equal values, in ascending order."""
    return before(counts, keys, value, "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")


def mann_whitney(long: DataFrame, a, b) -> DataFrame:
    """(feature, n1, n2, u, p): U of group ``a``, two-sided, normal with tie and continuity correction.

    Equal values are counted before they are ranked, so that ties meet no window.
    """
    rows = long.where(F.col("grp").isin(a, b) & F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(F.count_if(F.col("grp") == a).alias("n1"), F.count_if(F.col("grp") == b).alias("n2"), F.count("*").alias("n"))
    t = F.col("n").cast("double")
    s = ranked(counts, ["feature"], "value").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum(t * (t * t - 1)).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    z = F.coalesce(F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, sd), F.lit(0.0))
    p = F.when(sd > 0, F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))))).otherwise(1.0)
    return s.select("feature", "n1", "n2", "u", p.alias("p"))


def pseudo_f(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, pseudo_f): PERMANOVA's F on Euclidean distances, by the sums of squares around centroids."""
    keys = keys or []
    c = long.groupBy(*keys, "grp", "feature").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return _pseudo_f(c, keys)


def _pseudo_f(c: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`pseudo_f` from (keys, grp, feature, n, s, q): counts, sums and sums of squares."""
    per = c.groupBy(*keys, "feature").agg(
        F.sum("n").alias("N"), F.count("*").alias("k"), (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("sst"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ssw"),
    )
    t = per.groupBy(*keys) if keys else per
    tot = t.agg(F.max("N").alias("N"), F.max("k").alias("k"), F.sum("sst").alias("sst"), F.sum("ssw").alias("ssw"))
    f = F.try_divide(F.try_divide(F.col("sst") - F.col("ssw"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("k")))
    return tot.select(*keys, f.alias("pseudo_f"))


#: Samples whose sums are formed at once (fewer, if they have many features), and permutations that are multiplied at once.
_AT_ONCE, _PERMS = 1 << 16, 16


def _permuted_sums(no: np.ndarray, of: np.ndarray, feature: np.ndarray, value: np.ndarray, n_features: int, upto: np.ndarray, permutations: int, hashed: Hash) -> np.ndarray:
    """(permutation, group, 3, feature): counts, sums and sums of squares of samples ``no``; value i is that of sample ``of[i]`` and ``feature[i]``."""
    cell, size = of * n_features + feature, len(no) * n_features
    w = np.stack([np.bincount(cell, x, size).reshape(len(no), n_features) for x in (np.ones(len(value)), value, value * value)], axis=1).reshape(len(no), 3 * n_features)
    out = np.empty((permutations, len(upto), 3 * n_features))
    out[:, -1] = w.sum(axis=0)
    halves = halved(no, int(upto[-1]))
    for first in range(0, permutations, _PERMS):
        perms = range(first, min(first + _PERMS, permutations))
        place = np.stack([places(no, p, int(upto[-1]), hashed, halves) for p in perms])
        for g, end in enumerate(upto[:-1]):
            out[first : perms.stop, g] = (place < end).astype(float) @ w
    out[:, 1:] -= out[:, :-1].copy()  # up to each group's end, less up to the one before
    return out.reshape(permutations, len(upto), 3, n_features)


def permanova(long: DataFrame, permutations: int = 999, seed: int = 42, hashed: Hash | None = None, cell: Column | None = None) -> DataFrame:
    """(pseudo_f, p, permutations): groups are dealt anew by keyed bijections of the samples.

    In each permutation the samples at the first places get the first group, as many as it has,
    and so on. A sample travels with one array of its values; its place in each permutation is
    told from its number alone (see :mod:`permutations`), and sums by (permutation, group,
    feature) are formed where the sample is, a block of samples at a time: no permutation sorts,
    exchanges or copies samples. hashed, cell: what the bijections and the numbers come from,
    seeded hashes by default.
    """
    hashed = hashed or keyed(seed)
    rows = F.collect_list(F.struct("feature", "value"))
    # Group sizes, numbers and values all look at this table.
    samples = staged(long.groupBy("sample_id").agg(F.first("grp").alias("grp"), rows.alias("v")), "samples")
    sizes = samples.groupBy("grp").agg(F.count("*").alias("n"))
    order = Window.partitionBy().orderBy("grp")  # a row for each group
    ends = sizes.select("grp", F.sum("n").over(order).alias("upto"), (F.row_number().over(order) - 1).alias("g"))
    # Dealt to all partitions: each sample is work for all permutations, however small the table.
    dealt = numbered(samples.select("sample_id", "v"), "sample_id", "no", cell).repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), "no")
    dealt = dealt.join(F.broadcast(ends.agg(F.sort_array(F.collect_list("upto")).alias("upto"))))
    dealt = dealt.select("no", F.transform("v", lambda x: x["feature"]).alias("feature"), F.transform("v", lambda x: x["value"]).alias("value"), "upto")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            feature, value = (t[c].combine_chunks() for c in ("feature", "value"))
            owner, there = np.asarray(value.value_parent_indices()), np.asarray(value.flatten().is_valid())
            coded = feature.flatten().dictionary_encode()
            names, code = coded.dictionary, np.asarray(coded.indices)
            upto = np.asarray(t["upto"][0].as_py())
            got = _permuted_sums(np.asarray(t["no"]), owner[there], code[there], np.asarray(value.flatten().drop_null()), len(names), upto, permutations, hashed)
            perm, g, f = (x.ravel() for x in np.indices((permutations, len(upto), len(names))))
            n, s, q = (got[:, :, i].ravel() for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(perm), pa.array(g), names.take(pa.array(f)), pa.array(np.rint(n).astype(np.int64)), pa.array(s), pa.array(q)], names=["perm", "g", "feature", "n", "s", "q"])

        held, size, values = [], 0, 0
        for batch in batches:
            held, size, values = [*held, batch], size + batch.num_rows, values + len(batch["value"].flatten())
            if size >= _AT_ONCE or values >= 8 * _AT_ONCE:
                yield of(held)
                held, size, values = [], 0, 0
        if size:
            yield of(held)

    stars = dealt.mapInArrow(sums, "perm long, g long, feature string, n long, s double, q double")
    stars = stars.groupBy("perm", F.col("g").alias("grp"), "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).where("n > 0")
    stars = _pseudo_f(stars, ["perm"])
    seen = pseudo_f(samples.select("grp", F.explode("v").alias("x")).select("grp", "x.*")).withColumnRenamed("pseudo_f", "observed")
    both = stars.join(F.broadcast(seen))  # one row
    return both.agg(F.max("observed").alias("pseudo_f"), ((F.count_if(F.col("pseudo_f") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("permutations"))


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity from booleans truth and predicted; 0 where undefined."""
    c = rows.agg(
        F.count_if(F.col("truth") & F.col("predicted")).alias("tp"), F.count_if(~F.col("truth") & F.col("predicted")).alias("fp"),
        F.count_if(F.col("truth") & ~F.col("predicted")).alias("fn"), F.count_if(~F.col("truth") & ~F.col("predicted")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda x, y: F.round(F.when(y > 0, x / F.when(y > 0, y)).otherwise(0.0), 6)
    return c.select(
        "tp", "fp", "fn", "tn", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
        div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tn, tn + fp).alias("specificity"),
    )


def class_report(rows: DataFrame, classes: int = 4) -> DataFrame:
    """(cls, support, predicted, precision, recall, f1, imbalance) of each class from integers truth and predicted.

    imbalance: rows of the largest class for each row of this one, null for a class
    without rows; the others are 0 where undefined.
    """
    pairs = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))  # at most classes x classes rows
    spine = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    both = F.broadcast(spine).join(pairs, (F.col("truth") == F.col("cls")) | (F.col("predicted") == F.col("cls")), "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, p = F.col("truth") == F.col("cls"), F.col("predicted") == F.col("cls")
    c = both.groupBy("cls").agg(total(t).alias("support"), total(p).alias("predicted"), total(t & p).alias("_tp"))
    div = lambda x, y: F.round(F.when(y > 0, x / F.when(y > 0, y)).otherwise(0.0), 6)
    tp, n, m = F.col("_tp"), F.col("support"), F.col("predicted")
    most = F.max("support").over(Window.partitionBy())  # over the classes
    return c.select("cls", "support", "predicted", div(tp, m).alias("precision"), div(tp, n).alias("recall"), div(2 * tp, m + n).alias("f1"), F.round(most / F.when(n > 0, n), 6).alias("imbalance"))


def masked_accuracy(rows: DataFrame) -> DataFrame:
    """(accuracy, n): share of rows with truth = predicted, weighted by ``m``; 0 without weight."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("m")).otherwise(0))
    return rows.agg(F.round(F.when(F.sum("m") > 0, hit / F.sum("m")).otherwise(0.0), 6).alias("accuracy"), F.sum("m").cast("long").alias("n"))


def auc(rows: DataFrame) -> DataFrame:
    """ROC area of (truth boolean, score) by ranks of the distinct scores; see :func:`scans.before` for how these are ranked."""
    by = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if("truth").alias("n1"))
    s = ranked(by, [], "score").agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return s.select(F.round(F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n1 * n0), 6).alias("auc"))


def masked_cross_entropy(rows: DataFrame) -> DataFrame:
    """Sum of w * m * -ln(p_true) over max(sum of m, 1)."""
    return rows.agg(F.round(F.sum(-F.ln("p_true") * F.col("w") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1)), 6).alias("loss"))


#: Accuracy of the approximate quantiles that bracket exact ones, how far from these they are asked for, and the rows up to which a bracket is all of a key.
_ACCURACY, _ASIDE, _FEW = 1024, 1 / 256, 2048


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q): exact quantiles, linear between neighbours, as an array in order of ``shares``.

    Approximate quantiles on both sides bracket each one; what lies below is counted, and only
    the bracket, a hundredth of the rows, is ranked, equal values together. No task holds the
    values of a key. Nulls don't count; keys without values are left out.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    near = lambda step: F.percentile_approx("_v", [min(1.0, max(0.0, q + step)) for q in shares], _ACCURACY)
    facts = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), near(-_ASIDE).alias("_lows"), near(_ASIDE).alias("_highs"))
    few = F.col("_n") <= _FEW
    cells = [
        F.struct(
            F.lit(i).alias("_i"), F.lit(q).alias("_share"), F.when(few | F.lit(q <= _ASIDE), F.col("_least")).otherwise(F.col("_lows")[i]).alias("_low"),
            F.when(few | F.lit(q >= 1 - _ASIDE), F.col("_most")).otherwise(F.col("_highs")[i]).alias("_high"),
        )
        for i, q in enumerate(shares)
    ]
    facts = facts.select(*keys, "_n", F.array(*cells).alias("_b"))
    both = v.join(facts, keys) if keys else v.crossJoin(F.broadcast(facts))  # one row
    under = both.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[i]["_low"]).alias(f"_u{i}") for i in range(len(shares))])
    under = under.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_u{i}").alias("_under")) for i in range(len(shares))])).alias("_x")).select(*keys, "_x.*")
    held = both.select(*keys, "_n", "_v", F.explode(F.filter("_b", lambda c: F.col("_v").between(c["_low"], c["_high"]))).alias("_c"))
    held = held.groupBy(*keys, "_c._i", "_c._share", "_n", "_v").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_upto", upto).join(under, [*keys, "_i"]).withColumn("_upto", F.col("_upto") + F.col("_under"))
    h = (F.col("_n") - 1) * F.col("_share")
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_k") <= place) & (place < F.col("_upto")), F.col("_v")))
    each = held.groupBy(*keys, "_i").agg(at(F.floor(h)).alias("_a"), at(F.ceil(h)).alias("_b"), F.max(h - F.floor(h)).alias("_w"))
    line = F.struct("_i", (F.col("_a") + F.col("_w") * (F.col("_b") - F.col("_a"))).alias("q"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["q"]).alias("q"))


def summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, median, quartiles (linear), extremes, of all rows or for each key."""
    keys = keys or []
    s = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = quantiles(rows, keys, value, [0.25, 0.5, 0.75])
    s = s.join(q, keys, "left") if keys else s.join(F.broadcast(q), F.lit(True), "left")  # one row
    r = lambda c: F.round(c, 6)
    return s.select(*keys, "n", r("mean").alias("mean"), r("std").alias("std"), r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q3"), "least", "most")


def verdict(rows: DataFrame) -> DataFrame:
    """(runs, good, share_good, consistency, recommended) of differences in percent: total_diff and lf_hf_diff.

    consistency: HIGH below a sample deviation of 10 of total_diff, MODERATE below 20, else
    LOW; recommended: YES below means of 15 and 20, else WITH CAUTION.
    """
    good = F.count_if(F.col("total_diff") < 10) + F.count_if(F.col("lf_hf_diff") < 15)
    s = rows.agg(F.count("*").alias("runs"), good.alias("good"), F.stddev_samp("total_diff").alias("sd"), F.avg("total_diff").alias("a"), F.avg("lf_hf_diff").alias("b"))
    return s.select(
        "runs", "good", F.round(F.try_divide(F.col("good"), F.col("runs") * 2), 6).alias("share_good"),
        F.when(F.col("sd") < 10, "HIGH").when(F.col("sd") < 20, "MODERATE").otherwise("LOW").alias("consistency"),
        F.when((F.col("a") < 15) & (F.col("b") < 20), "YES").otherwise("WITH CAUTION").alias("recommended"),
    )
