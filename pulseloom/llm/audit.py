"""How filters overlap: what each removes, in every order in which they may be applied.

Where a filter stands in an order decides on what reaches it, but only the *set* of filters
before it counts, not their order. All orders of five filters are paths through the lattice of
their 32 subsets, and its 80 edges (set already applied, next filter) hold all there is to know:

1. Each text is read once and becomes a few bytes: its part, a bit for each filter that judges
   a text by itself, and a digest. Repeated rows are counted before they are shuffled.
2. Copies: the smallest doc_id of each digest is found by a minimum that is formed map-side, and
   rows are held against it by (digest, doc_id), a key that no group of copies makes hot.
3. Documents are counted by (part, failure bits); each such cell contributes to all 80 edges.
4. The 600 steps of the 120 orders pick up their edges by an equality join; the steps, whose
   number the filters alone decide, are what is broadcast.

Defined results: a null text is an empty one, a null source the part ''. A row without a doc_id
never counts as a copy and makes no other row one; rows that repeat a doc_id with the same text
are no copies of each other, and each counts. Of several labels of a document the largest holds;
rows without a label are neither good nor toxic. Very long texts are read whole. Further columns
of the input are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import SPACE, staged, table

#: The filter that fails copies; the others judge a text by itself.
COPY = "E"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself; words: its words as an array."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def bit(letters: str, letter: str) -> int:
    return 1 << letters.index(letter)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest, n): a row for each document, with a bit for each failure that its text alone decides."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    each = failures(F.col("text"), F.col("words"))
    letters = "".join(each)
    fails = sum((F.when(c, bit(letters, k)).otherwise(0) for k, c in each.items()), F.lit(0))
    rows = rows.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.groupBy("doc_id", "part", "fails", "digest").agg(F.count("*").alias("n"))


def with_copies(rows: DataFrame, copy: int) -> DataFrame:
    """Rows of :func:`judged` that have a doc_id, with the bit ``copy`` set where a smaller one has the same text."""
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    found = rows.join(first, (rows["digest"] == first["_digest"]) & (rows["doc_id"] == first["_first"]), "left")
    return found.select("doc_id", "part", "n", (F.col("fails") + F.when(F.col("_first").isNull(), copy).otherwise(0)).alias("fails"))


def cells(rows: DataFrame, labels: DataFrame, copy: int) -> DataFrame:
    """(part, fails, n, good, toxic): documents by what they fail, with those labelled good and toxic among them."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    names = ["part", "n", "fails", "quality", "toxic"]
    known = with_copies(rows.where("doc_id IS NOT NULL"), copy).join(one, "doc_id", "left").select(names)
    unknown = rows.where("doc_id IS NULL").select("part", "n", "fails", *[F.lit(None).cast(one.schema[c].dataType).alias(c) for c in names[3:]])
    counted = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return known.unionByName(unknown).groupBy("part", "fails").agg(
        F.sum("n").alias("n"), counted(F.col("quality") == 1, "good"), counted(F.col("toxic") == 1, "toxic")
    )


def edges(counts: DataFrame, letters: str) -> DataFrame:
    """(part, applied, filter, ...): counts of each edge of the lattice, and of each filter over all orders (shapley).

    applied: the letters already applied, sorted. Each cell of ``counts`` contributes to all edges.
    """
    every = []
    for letter in letters:
        rest = [x for x in letters if x != letter]
        for size in range(len(letters)):
            orders = factorial(size) * factorial(len(letters) - 1 - size)  # orders whose path takes the edge
            for applied in itertools.combinations(rest, size):
                bits = sum(bit(letters, x) for x in applied)
                fields = {"applied": "".join(applied), "filter": letter, "before": bits, "own": bit(letters, letter), "orders": orders}
                every.append(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    t = counts.select("part", "fails", "n", "good", "toxic", F.explode(F.array(*every)).alias("e")).select("part", "fails", "n", "good", "toxic", "e.*")
    own, before = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    here = own & ~before
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    t = t.groupBy("part", "filter", "applied", "orders").agg(
        total(~own & ~before, "n", "kept"), total(here, "n", "removed"), total(own & before, "n", "redundant"),
        total(F.col("fails") == F.col("own"), "n", "unique_fails"), total(here, "good", "good_lost"), total(here, "toxic", "toxic_lost"),
    )
    return t.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))).drop("orders")


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, filter, applied): all steps of all orders."""
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    t = spark.range(1).select(F.explode(orders).alias("filter_order"))
    t = t.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    applied = F.array_join(F.array_sort(F.split(F.expr("substr(filter_order, 1, step - 1)"), "")), "")
    return t.select("filter_order", "step", F.expr("substr(filter_order, step, 1)").alias("filter"), applied.alias("applied"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: see :func:`edges` for the counts."""
    letters = "ABCD" + COPY
    rows = staged(judged(docs), "audit-rows")  # the texts are read once
    lattice = edges(cells(rows, labels, bit(letters, COPY)), letters)
    out = lattice.join(F.broadcast(steps(docs.sparkSession, letters)), ["applied", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see the module for nulls and repeated rows."""
    return audited(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT w.doc_id, part, quality = 1 AS good, toxic = 1 AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
           WHEN 'A' THEN len(w) < 200
           WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
           WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)
           WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
           ELSE coalesce(w.doc_id > least, false) END) AS fails
  FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS applied FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, filter, good, toxic, list_contains(fails, filter) AS own, list_has_any(fails, applied) AS before, fails = [filter] AS alone
  FROM f, s
), g AS (
  SELECT part, filter_order, step, filter,
         count(*) FILTER (NOT own AND NOT before) AS kept, count(*) FILTER (own AND NOT before) AS removed, count(*) FILTER (own AND before) AS redundant,
         count(*) FILTER (alone) AS unique_fails, count(*) FILTER (own AND NOT before AND good) AS good_lost, count(*) FILTER (own AND NOT before AND toxic) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM g
"""
