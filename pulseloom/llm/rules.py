"""Quality rules: a decision list learned from labelled statistics, as a Spark expression.

Sequential covering learns the list. On two thirds of the labelled rows still uncovered a
conjunction of thresholds grows, literal by literal, by the information it gains about the
rarer class; on the other third its last literals are pruned while that does not worsen
(p - n) / (p + n). Rows that the rule covers are set aside, and the next rule is grown on the
rest, so that rules hold in their order: a later one speaks of documents that no earlier one
took. Learning ends when a pruned rule is right on the third less often than ``LEAST_RIGHT``,
or covers fewer than ``LEAST_ROWS``; what no rule takes is kept.

The list becomes one nested WHEN ... OTHERWISE over statistics that are expressions
themselves: documents are read, measured and judged in the JVM, whole, in the stage that
scans them, and no row is shuffled.

Defined results: null, empty and blank texts have statistics of 0 (so they fail the base
rules) and get a verdict; very long texts are read whole; equal texts, and so repeated rows,
are judged alike; rows without a doc_id are judged and never learned from. Without labels of
both classes the list is empty and keeps everything that passes the base rules. An empty
table gives no rows. Columns of the input that have the output column's name are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import SPACE, table
from pulseloom.llm.quality import sample, usable_for_fit

#: Labelled rows that a fit takes at most: those whose id hashes lowest.
FIT_ROWS = 20_000
#: Cuts tried for each statistic, literals of a rule, rules of a list.
CUTS, LITERALS, RULES = 64, 4, 32
LEAST_RIGHT, LEAST_ROWS = 0.75, 4

#: Statistics that rules may ask for, over the counts of :func:`counts`.
STATISTICS = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "bangs_per_word": "n_bangs / n_words",
    "capitals": "n_capitals / word_chars",
    "digits": "n_digits / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeat_words": "n_repeat_words / n_words",
    "distinct_words": "n_distinct_words / n_words",
    "words_per_line": "n_words / n_lines",
}


def bound(value: Column, body) -> Column:
    """body(x) with x bound to ``value``, which is then evaluated once, however often the body asks for it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more, the first included.

    Windows are hashed and sorted with their places, so that equal ones are neighbours; those
    whose hash is found twice are then compared by their words in the same way. Texts whose
    windows all differ are not sorted.
    """
    same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))

    def twice(windows: Column) -> Column:
        """Places of the windows (g, i) whose g is there twice."""
        again = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return bound(F.sort_array(windows), lambda s: F.transform(again(s), lambda x: x["i"]))

    def of(w: Column) -> Column:
        text = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        starts = F.when(F.size(w) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        alike = lambda h: twice(F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        sure = lambda at: twice(F.transform(at, lambda i: F.struct(text(i).alias("g"), i.alias("i"))))
        covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + 2)))))
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(sure(alike(h)))))

    return bound(words, of)


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts of a whole text; words: its words, lines: those of its lines that have a word."""
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    each = {
        "n_words": F.size(words), "word_chars": left(SPACE), "n_symbols": left(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines), "n_distinct_words": F.size(F.array_distinct(words)),
        "n_bangs": left("[^!]+"), "n_capitals": left("[^A-Z]+"), "n_digits": left("[^0-9]+"),
    }
    return {k: v.cast("long") for k, v in each.items()}


def measured(docs: DataFrame, column: str = "stats") -> DataFrame:
    """``docs`` with struct ``column``: the counts and statistics of each whole text."""
    text = F.coalesce("text", F.lit(""))
    names = [c for c in docs.columns if c != column]
    t = docs.select(F.struct(*names).alias("_row"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumns({"_words": F.array_remove(F.split("_text", SPACE), ""), "_lines": lines})
    each = counts(F.col("_text"), F.col("_words"), F.col("_lines"))
    t = t.select("_row", *[v.alias(k) for k, v in each.items()])
    ratios = [F.coalesce(F.expr(f"try_divide({', '.join(v.split(' / '))})"), F.lit(0.0)).alias(k) for k, v in STATISTICS.items()]
    return t.select(*[F.col("_row")[c].alias(c) for c in names], F.struct(*each, *ratios).alias(column))


@dataclass(frozen=True)
class Literal:
    """A threshold of one statistic: at most ``cut``, or above it."""

    name: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def column(self, at: str) -> Column:
        c = F.col(f"{at}.{self.name}")
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    label: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([lit.holds(x) for lit in self.literals])

    def column(self, at: str) -> Column:
        out = self.literals[0].column(at)
        for lit in self.literals[1:]:
            out = out & lit.column(at)
        return out

    def __str__(self) -> str:
        return f"{' AND '.join(map(str, self.literals))} -> {self.label}"


def grown(x: dict[str, np.ndarray], positive: np.ndarray, cuts: dict[str, np.ndarray]) -> list[Literal]:
    """The literals of one rule for the positive rows, each the one that gains most information where the earlier ones hold."""
    live, out = np.ones(len(positive), bool), []
    while len(out) < LITERALS:
        p, n = positive[live].sum(), (~positive[live]).sum()
        if not n or not p:
            break
        before, best, gained = math.log2(p / (p + n)), None, 1e-9
        for name, at in cuts.items():
            if not len(at):
                continue
            cell = np.searchsorted(at, x[name][live], side="left")  # cell i holds values in (at[i - 1], at[i]]
            upto = [np.bincount(cell[positive[live] == sign], minlength=len(at) + 1).cumsum()[:-1] for sign in (True, False)]
            for above, (ps, ns) in ((False, upto), (True, (p - upto[0], n - upto[1]))):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - before), 0.0)
                i = int(gain.argmax())
                if gain[i] > gained:
                    gained, best = gain[i], Literal(name, above, float(at[i]))
        if best is None:
            break
        out = [lit for lit in out if (lit.name, lit.above) != (best.name, best.above)] + [best]  # a tighter cut replaces a wider one
        live &= best.holds(x)
    return out


def worth(literals: list[Literal], x: dict[str, np.ndarray], positive: np.ndarray) -> float:
    """(p - n) / (p + n) of the rows that all literals hold for; -1 where there are none."""
    live = np.logical_and.reduce([lit.holds(x) for lit in literals])
    p, n = positive[live].sum(), (~positive[live]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learned(x: dict[str, np.ndarray], y: np.ndarray, third: np.ndarray) -> list[Rule]:
    """The list of rules for the rarer class of y; ``third`` marks the rows that prune."""
    if not len(y) or y.min() == y.max():
        return []
    label = int(y.sum() * 2 <= len(y))
    positive, rules, left = y == label, [], np.ones(len(y), bool)
    # Cuts lie halfway between neighbouring values, so that rules don't hang on the values of a sample.
    cuts = {}
    for name, v in x.items():
        values = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1), method="nearest"))
        cuts[name] = (values[1:] + values[:-1]) / 2
    part = lambda rows: {k: v[rows] for k, v in x.items()}
    while len(rules) < RULES:
        grow, prune = left & ~third, left & third
        literals = grown(part(grow), positive[grow], cuts)
        held, truth = part(prune), positive[prune]
        while len(literals) > 1 and worth(literals[:-1], held, truth) >= worth(literals, held, truth):
            literals = literals[:-1]
        if not literals or worth(literals, held, truth) < 2 * LEAST_RIGHT - 1:
            break
        rule = Rule(tuple(literals), label)
        taken = left & rule.holds(x)
        if (taken & positive).sum() < LEAST_ROWS:
            break
        rules.append(rule)
        left &= ~taken
    return rules


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents for which ``usable`` (over doc_id) holds; only their statistics reach the driver."""
    t = measured(sample(docs, labels, "quality", usable, rows))
    third = (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("third")
    got = t.select("doc_id", "y", third, *[F.col(f"stats.{k}").alias(k) for k in STATISTICS]).toPandas().sort_values("doc_id")
    return learned({k: got[k].to_numpy(float) for k in STATISTICS}, got["y"].to_numpy(int), got["third"].to_numpy(bool))


def verdict(rules: list[Rule], at: str = "stats") -> tuple[Column, Column]:
    """(label, number) of the first rule that holds for the statistics in ``at``; label 1 or 0 as the class not learned, number 0, if none does."""
    default = 1 - rules[0].label if rules else 1
    if not rules:
        return F.lit(default), F.lit(0)
    label, number = F, F
    for i, rule in enumerate(rules, 1):
        label, number = label.when(rule.column(at), rule.label), number.when(rule.column(at), i)
    return label.otherwise(default), number.otherwise(0)


def base_failed(at: str = "stats") -> Column:
    """The fixed rules: under 50 words, or over half of the words in repeated windows."""
    return F.expr(f"{at}.n_words < 50 OR 100 * {at}.n_repeat_words > 50 * {at}.n_words")


def op11_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document; rule: the number of the learned rule that holds for it first, 0 for none."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    label, rule = verdict(fit(docs, table(spark, sf_dir, "labels"), usable_for_fit()))
    out = measured(docs).withColumns({"base_failed": base_failed(), "label": label, "rule": rule})
    return out.select(
        "doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("label") == 1)).alias("kept"), "rule",
    )
