"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask marks which of its neighbouring tokens count; the others may differ. Every place
of every benchmark item and of every document is hashed under each mask, the hashes are
joined, and each hit names a diagonal: an item laid against a document at some offset.
Along a diagonal the tokens are compared one by one. A document is contaminated if some
window of WINDOW aligned tokens (or the whole item, if shorter) agrees in at least 80 %
of its places, so that substitutions do not hide a copy.

No such window is lost: MASKS serve the lengths for which an enumeration of all
substitution patterns finds a hit in each (:func:`covers`), and items of any other length
get masks made for it (:func:`fitted`); those of up to four tokens are joined as a whole.

Tokens are runs of letters and digits in lower case. Defined results: null and empty
texts, and items without a token or without an item_id, match nothing; repeated rows and repeated items are
reported once for each pair of ids; rows with a null doc_id are judged like any others, each by
its own text; very long texts are read whole; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import staged, table

#: 1 counts, 0 is ignored. Of 15 or more tokens with at most three substituted, one of these always has its six places equal.
MASKS = ("11001001011", "1110111", "1110001011")
WINDOW, AGREE = 16, 0.8
#: Benchmark hashes that may be broadcast (about 40 bytes each). Beyond that they are joined by shuffling, and a broadcast
#: bitmap of 2 ** FILTER_BITS bits (16 MB, whatever the benchmark) keeps back the places of documents that none of them has.
BROADCAST_ROWS, FILTER_BITS = 500_000, 27
#: Substitution patterns that are enumerated at most to prove masks; beyond, masks are made for the length.
PATTERNS = 100_000


def tokens(text: str) -> Column:
    """Letters and digits in lower case."""
    cut = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")


def misses(n: int, agree: float = AGREE) -> int:
    """How many of n aligned tokens may differ."""
    return max((k for k in range(n) if (n - k) / n >= agree), default=0)


def covers(masks: Sequence[str], n: int, k: int) -> bool:
    """Whether some mask hits at some place of n aligned tokens, whichever k of them differ."""
    counts = [{i for i, c in enumerate(m) if c == "1"} for m in masks]
    hits = [{p + i for i in c} for m, c in zip(masks, counts, strict=True) for p in range(n - len(m) + 1)]
    return all(any(h.isdisjoint(bad) for h in hits) for bad in combinations(range(n), k))


def fitted(n: int, k: int) -> list[str]:
    """Masks for n aligned tokens of which k may differ: all but k of a few blocks, as k substitutions touch at most k blocks."""
    g = min(n, k + 2 if k <= 2 else k + 1)
    masks = []
    for out in combinations(range(g), k):
        mask = "".join("0" if i * g // n in out else "1" for i in range(n)).strip("0")
        masks += [mask] if mask not in masks else []
    # A mask hits at any place, so that some do the work of others.
    for m in sorted(masks, key=lambda m: m.count("1")) if comb(n, k) <= PATTERNS else ():
        rest = [x for x in masks if x != m]
        masks = rest if rest and covers(rest, n, k) else masks
    return masks


def shapes(lengths: Collection[int], masks: Sequence[str] = MASKS, agree: float = AGREE) -> dict[str, list[int]]:
    """The masks that windows of these lengths need, each with the lengths it serves."""
    out: dict[str, list[int]] = {}
    for n in sorted(lengths):
        k = misses(n, agree)
        proved = comb(n, k) <= PATTERNS and covers(masks, n, k)
        for m in masks if proved else fitted(n, k):
            out.setdefault(m, []).append(n)
    return out


def seeds(hashed: Column, masks: Sequence[str], served: Sequence[Column] | None = None) -> Column:
    """Array of hashes of all places under all masks, mask by mask: place p of mask m lies at m * n + p; null where the mask doesn't fit."""
    n = F.size(hashed)

    def under(m: int, mask: str) -> Column:
        counts = [i for i, c in enumerate(mask) if c == "1"]
        fits = lambda p: (p <= n - len(mask)) & (served[m] if served else F.lit(True))
        at = lambda p: F.when(fits(p), F.xxhash64(F.lit(m), *(F.get(hashed, p + i) for i in counts)))
        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return F.when(n > 0, F.concat(*(under(m, mask) for m, mask in enumerate(masks)))).otherwise(F.array().cast("array<long>"))


def bitmap(wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row with ``filter``: an array of 64-bit words in which the lowest bits of each seed mark one bit."""
    at = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    marked = wanted.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = wanted.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(marked.groupBy("word").agg(F.bit_or("bit").alias("bits")), "word", "left")
    # As many rows as the filter has words, whatever the benchmark.
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("filter"))


def marked(seed: Column, bits: int = FILTER_BITS) -> Column:
    """Whether the filter may hold a seed."""
    at = seed.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get("filter", F.shiftright(at, 6).cast("int"))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def places(rows: DataFrame, ids: list[str], shapes: Mapping[str, Sequence[int]], window: int | None = None, known: DataFrame | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """(ids, place, seed) of all places of ``text``; with ``window``, a text takes only the masks that serve its length.

    known: a :func:`bitmap`; seeds that it doesn't mark become null.
    """
    hashed = rows.select(*ids, F.transform(tokens("text"), lambda w: F.xxhash64(w)).alias("h"))
    served = [F.least(F.size("h"), F.lit(window)).isin(list(ns)) for ns in shapes.values()] if window else None
    hashed = hashed.select(*ids, F.size("h").alias("n"), seeds(F.col("h"), list(shapes), served).alias("s"))
    if known is not None:
        hashed = hashed.join(F.broadcast(known)).withColumn("s", F.transform("s", lambda x: F.when(marked(x, bits), x)))
    # The outer form: for the inner one Spark infers a filter that computes all hashes a second time.
    each = hashed.select(*ids, "n", F.posexplode_outer("s").alias("at", "seed"))
    return each.select(*ids, (F.col("at") % F.greatest("n", F.lit(1))).alias("place"), "seed")


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, start, n_aligned, n_equal, agreement) of each contaminated pair, its best alignment.

    ``start`` counts tokens; ``agreement`` is that of the best window.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    size = F.least(F.size(tokens("text")), F.lit(window)).alias("n")
    lengths = [r["n"] for r in items.select(size).distinct().collect() if r["n"] > 0] or [window]
    used = shapes(lengths, masks, agree)
    wanted = staged(places(items, ["item_id"], used, window).where(F.col("seed").isNotNull()).distinct(), "seeds")
    few = wanted.count() <= BROADCAST_ROWS
    known = None if few else staged(bitmap(wanted, FILTER_BITS), "seed-filter")
    # Rows without an id go by a digest of their text, so that they are no single key.
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.md5("text")).alias("mark"))
    ids = ["doc_id", "mark"]
    found = places(docs, ids, used, known=known, bits=FILTER_BITS).alias("d")
    found = (found if few else found.where(F.col("seed").isNotNull())).join((F.broadcast(wanted) if few else wanted).alias("b"), "seed")
    shifts = F.collect_set(F.col("d.place") - F.col("b.place")).alias("shifts")
    diagonals = staged(found.groupBy(*ids, "item_id").agg(shifts), "diagonals")
    # Only documents with hits come back for their tokens, once for each item, however many diagonals they share.
    same = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & F.col(f"{x}.mark").eqNullSafe(F.col(f"{y}.mark"))
    texts = docs.alias("x").join(diagonals.select(*ids).distinct().alias("y"), same("x", "y"), "left_semi")
    docs_t = texts.select(*ids, tokens("text").alias("dt"))
    items_t = items.select(F.col("item_id").alias("iid"), tokens("text").alias("it"))
    pairs = diagonals.alias("x").join(docs_t.alias("y"), same("x", "y")).select("x.doc_id", "item_id", "shifts", "dt").join(items_t, F.col("item_id") == F.col("iid"))
    pairs = pairs.withColumn("shift", F.explode("shifts")).drop("shifts")
    start = F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.size("dt") - start, F.size("it") - F.greatest(-F.col("shift"), F.lit(0)))
    aligned = pairs.select("doc_id", "item_id", start.alias("start"), F.size("it").alias("n_item"), F.zip_with(
        F.slice("dt", start + 1, F.greatest(length, F.lit(0))),
        F.slice("it", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.greatest(length, F.lit(0))),
        lambda a, b: (a == b).cast("int"),
    ).alias("same"))
    w = F.least(F.lit(window), F.col("n_item"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - w + 1), lambda p: total(F.slice("same", p, w))))
    judged = aligned.where(F.size("same") >= w).select(
        "doc_id", "item_id", "start", F.size("same").alias("n_aligned"), total(F.col("same")).alias("n_equal"), (best / w).alias("agreement")
    )
    return (
        judged.where(F.col("agreement") >= agree)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_equal", "agreement", (-F.col("start")).alias("start"), "n_aligned")).alias("x"))
        .select("doc_id", "item_id", (-F.col("x.start")).alias("start"), "x.n_aligned", "x.n_equal", "x.agreement")
    )


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items that they hold; see the module."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
