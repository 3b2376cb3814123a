"""Document quality: histogram gradient-boosted trees over document statistics.

A text becomes a fixed vector of statistics (:func:`statistics`). Trees are grown
on histograms of at most ``BINS`` bins over a bounded sample of labelled rows, and
flattened into arrays, so that a batch of documents walks all trees at once.

Defined results: a null text counts as an empty one and still gets a score; without
labels (or with one class only) every document gets the same prior score; repeated
rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import fold, table

#: Labelled rows that a fit takes at most: those whose id hashes lowest.
FIT_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, LEAST_ROWS, L2 = 80, 4, 0.15, 20, 1.0
KEEP_AT = 0.3

#: Statistics of a text, in the order of the vector.
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "short_words", "distinct_words",
    "distinct_pairs", "log_lines", "distinct_lines", "mean_line", "upper", "lower", "digits", "non_ascii",
    "punctuation", "symbols", "pipes", "bangs", "stops", "commas", "entropy", "top_byte", "capitalised",
    "odd_ends", "white", "repeat_next", "half_overlap",
)
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{}~", np.uint8)


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS for each whole text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            continue
        n = len(raw)
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = seen[seen > 0] / n
        upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
        white = seen[9:14].sum() + seen[32]
        row[0] = math.log1p(n)
        row[11:15] = upper / n, lower / n, digits / n, seen[128:].sum() / n
        row[15] = (seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / n
        row[16] = seen[_SYMBOLS].sum() / n
        row[17:21] = seen[124] / n, seen[33] / n, seen[46] / n, seen[44] / n
        row[21:23] = -(share * np.log2(share)).sum(), share.max()
        row[25] = white / n
        word = raw.split()
        k = len(word)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        if not k:
            continue
        sizes = np.fromiter(map(len, word), np.int64, k)
        row[1:6] = math.log1p(k), sizes.mean(), sizes.std(), math.log1p(sizes.max()), (sizes <= 3).mean()
        row[6] = len(set(word)) / k
        row[7] = len(set(zip(word, word[1:], strict=False))) / max(1, k - 1)
        row[8:11] = math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(k / max(1, len(lines)))
        row[23] = sum(map(bytes.istitle, word)) / k
        ends = np.fromiter((w[-1] for w in word), np.uint8, k)
        row[24] = np.isin(ends, _SYMBOLS).mean()
        row[26] = sum(a == b for a, b in zip(word, word[1:], strict=False)) / k
        half = set(word[: k // 2])
        row[27] = len(half.intersection(word[k // 2 :])) / max(1, len(half))
    return out


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node ``i`` sends a row with x[feature] <= cut to left[i], else left[i] + 1; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + math.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = self.left[at]
            at = np.where(down >= 0, down + (x[rows, self.feature[at]] > self.cut[at]), at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the logistic loss on histograms."""
    n, width = x.shape
    mean = (y.sum() + 1) / (n + 2)
    base = math.log(mean / (1 - mean))
    none = np.zeros(0, np.int64)
    if n < 2 * LEAST_ROWS or y.min() == y.max():
        return Trees(none, none.astype(float), none, none.astype(float), none, base, 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * BINS
    feature, cut, left, value, roots = [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(feature))
        level = [len(feature)]
        for store, empty in ((feature, 0), (cut, 0.0), (left, -1), (value, 0.0)):
            store.append(empty)
        node = np.zeros(n, np.int64)  # place in level, -1 once in a leaf
        for step in range(depth + 1):
            live = node >= 0
            g = np.bincount(node[live], grad[live], len(level))
            h = np.bincount(node[live], hess[live], len(level))
            for i, at in enumerate(level):
                value[at] = -RATE * g[i] / (h[i] + L2)
            if step == depth:
                break
            cell = (node[live, None] * (width * BINS) + flat[live]).ravel()
            shape = (len(level), width, BINS)
            total = len(level) * width * BINS
            gs = np.bincount(cell, np.repeat(grad[live], width), total).reshape(shape).cumsum(2)
            hs = np.bincount(cell, np.repeat(hess[live], width), total).reshape(shape).cumsum(2)
            ns = np.bincount(cell, minlength=total).reshape(shape).cumsum(2)
            gain = gs**2 / (hs + L2) + (g[:, None, None] - gs) ** 2 / (h[:, None, None] - hs + L2) - (g**2 / (h + L2))[:, None, None]
            fits = (ns >= LEAST_ROWS) & (ns[:, :, -1:] - ns >= LEAST_ROWS)
            gain = np.where(fits, gain, -1.0).reshape(len(level), -1)
            best = gain.argmax(1)
            move, deeper = np.full(len(level), -1), []
            for i, at in enumerate(level):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, best[i]] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[at], cut[at], left[at] = j, float(cuts[j][b]), len(feature)
                move[i] = len(deeper)
                deeper += [len(feature), len(feature) + 1]
                for store, empty in ((feature, 0), (cut, 0.0), (left, -1), (value, 0.0)):
                    store += [empty, empty]
            if not deeper:
                break
            split = best // BINS
            here = np.where(live, node, 0)
            goes = move[here] + (binned[np.arange(n), split[here]] > (best % BINS)[here])
            node = np.where(live & (move[here] >= 0), goes, -1)
            level = deeper
        grown = Trees(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots[-1:]), 0.0, depth)
        at = np.full(n, roots[-1])
        for _ in range(depth):
            down = grown.left[at]
            at = np.where(down >= 0, down + (x[np.arange(n), grown.feature[at]] > grown.cut[at]), at)
        margin += grown.value[at]
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), base, depth)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts: (doc_id, text, y). One row an id; ids by lowest hash.

    The ids are bounded by ``rows``, so that broadcasting them is safe.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS) -> Trees:
    """Trees from the labelled rows for which ``usable`` (over doc_id) holds."""
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(statistics(b["text"].tolist()))})

    got = sample(docs, labels, "quality", usable, rows).mapInPandas(vectors, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    return grow(x, got["y"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees, column: str = "quality_score") -> DataFrame:
    """``docs`` with a probability of label 1 for each whole text; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            # Chunks bound the (documents x trees) walk, whatever the batch.
            yield pd.Series(np.concatenate([held.value.score(statistics(b.iloc[i : i + 512].tolist())) for i in range(0, len(b), 512)] or [np.zeros(0)]))

    return docs.withColumn(column, of.asNondeterministic()(F.col("text")))


def usable_for_fit() -> Column:
    """Rows that a fit may learn from: crc32(doc_id) mod 5 is not 0."""
    return fold("doc_id", 5) != 0


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; see the module for null, empty and repeated rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    trees = fit(docs, table(spark, sf_dir, "labels"), usable_for_fit())
    return scored(docs, trees, "score").select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )
