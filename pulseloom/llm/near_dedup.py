"""Near-duplicate groups: MinHash bands, odd sketches, and exact verification.

A document is the set of its word shingles. Sets that are equal form a class, and one row
stands for it from then on. Of each class come K = ROWS * BANDS MinHash samples; ROWS of
them make a band, and classes that share a band are candidates. At a similarity of 0.8 a
pair misses all bands with a probability of (1 - 0.8 ** ROWS) ** BANDS, about 1e-5.

The samples are also folded into an odd sketch, a bitmap in which each sample flips one
bit. The population count z of the XOR of two sketches gives the number of samples that
differ, and so the similarity. Candidates whose estimate lies five standard deviations
below 0.8 are dropped. A second bitmap holds the parity of all shingles of the set; there
the count of the XOR is never larger than the symmetric difference, so that it refutes a
link with certainty, and sharply for sets of up to a few thousand shingles. The rest is
decided on the full sets.

Only components are asked for, so not all pairs of a group are made. First each class is
tested against one pivot, the best among the smallest members of its bands. Classes that
are then in one component need no further test. What shares a band across components is
held together by the bitmaps, and what these can't refute is tested on the full sets, so
that no link is lost. Where bands would give very many such comparisons, further pivots
join components first; a band that is still large is compared in tiles, task by task. The
members of a pivot are dealt to parts of TILE, each of which gets the pivot's bitmaps and
text once: neither the comparison nor the test of a hub is one key of a join.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows
with the same doc_id are one node; rows with a null doc_id link with nothing, have a null
component and are kept; very long texts are read whole; further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import arrow_rows, discard, staged, table

ROWS, BANDS, SKETCH_BITS, PARITY_BITS = 5, 28, 512, 1024
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
SIGMAS = 5
#: Bitmaps are compared across components once that is at most so many comparisons for each row of the bands.
PAIRS_A_ROW, PIVOT_ROUNDS = 2_000, 6
#: Rows of a band that meet in one task; larger bands are cut into tiles of so many rows a side.
TILE = 1_000
#: Texts, or pairs of texts, that a worker receives at once; and words whose hashes it remembers.
BATCH, WORDS = 256, 200_000
_WORDS: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R30, _R27, _R31 = np.uint64(30), np.uint64(27), np.uint64(31)
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)[:, None]
_ODD = (_rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1))[:, None]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    x = (x ^ (x >> _R30)) * _M1
    x = (x ^ (x >> _R27)) * _M2
    return x ^ (x >> _R31)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles of a whole text as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z in lower case; fewer words
    than ``size`` are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > WORDS:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = h[: len(h) - size + 1]
    for i in range(1, size):
        out = mixed(out + np.uint64(i)) + h[i : len(h) - size + 1 + i]
    return np.unique(mixed(out + np.uint64(size)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """K samples of a set that isn't empty."""
    low = None
    for i in range(0, len(shingles), 4096):
        part = ((shingles[None, i : i + 4096] ^ _XOR) * _ODD).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def sketch(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of the samples, as 64-bit words."""
    at = mixed(samples + np.arange(len(samples), dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of a whole set, as 64-bit words."""
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key for each band; bands never share keys but by chance."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key + rows[:, i])
    return key.view(np.int64)


def similarity(z: float, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS) -> float:
    """The similarity that z differing bits of two sketches stand for."""
    share = 1 - 2 * z / bits
    return 1 + bits / (4 * samples) * math.log(share) if share > 0 else 0.0


def most_differing(percent: float = PERCENT) -> int:
    """The largest z that a pair at the limit may show, SIGMAS standard deviations allowed."""
    j, k = percent / 100, ROWS * BANDS
    spread = math.sqrt(j * (1 - j) / k + (SKETCH_BITS / (4 * k)) ** 2 * (math.exp(8 * k * (1 - j) / SKETCH_BITS) - 1) / SKETCH_BITS)
    least = max(0.05, j - SIGMAS * spread)
    return max(z for z in range(SKETCH_BITS // 2) if similarity(z) >= least)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, sketch, parity) of each row; k1 and k2 identify the set."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, bands, marks, odd = [], [], [], [], [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), size)
                n.append(len(s))
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                if len(s):
                    samples = minhash(s)
                    bands.append(band_keys(samples))
                    marks.append(sketch(samples))
                    odd.append(parity(s))
                else:
                    bands.append(None)
                    marks.append(None)
                    odd.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, longs), pa.array(marks, longs), pa.array(odd, longs)],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch", "parity"],
            )

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>, parity array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def parts_of(rows: str) -> Column:
    """In how many parts the members of a band of so many rows are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / TILE)).cast("int").alias("parts")


def dealt(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs`` (a, b, parts, ...) with the columns of ``of`` (b, ...), which goes to each part of a hub once."""
    copies = pairs.groupBy("b").agg(F.max("parts").alias("_n"))
    there = copies.join(of, "b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return pairs.withColumn("_part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).join(there, ["b", "_part"])


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b, parts) whose full sets are similar enough."""
    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for x in batches:
            found = []
            for a, b, ta, tb in zip(*(x.column(c) for c in ("a", "b", "ta", "tb")), strict=True):
                pivot = tb.as_py()
                if last[0] != pivot:
                    last = (pivot, shingle_set(pivot, size))
                s, t = shingle_set(ta.as_py(), size), last[1]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = dealt(both, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")))
    return both.select("a", "b", "ta", "tb").mapInArrow(sure, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of each node that has an edge.

    Alternating large and small stars; each round is staged, and none collects edges.
    """
    a, b = F.col("a"), F.col("b")
    cur = staged(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct(), "edges")
    told = None
    while True:
        both = cur.unionByName(cur.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        before, cur = cur, staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == told:
            return cur.select(a.alias("node"), b.alias("label"))
        told = now


def grouped(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    All work on texts is done here, in small batches; what is returned only joins tables.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        return _grouped(docs, size, percent)


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    known = staged(signatures(docs, size), "signatures")
    filled = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = staged(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, (filled["k1"] == classes["k1"]) & (filled["k2"] == classes["k2"]) & (F.col("doc_id") == F.col("rep")))
    reps = staged(reps.select("rep", F.col("n_shingles").alias("n"), "bands", "sketch", "parity").distinct(), "representatives")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    met = staged(banded.join(shared, "band"), "bands")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = staged(texts.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    # First round: each class against its most similar pivot.
    first = met.where("rep != pivot").groupBy(F.col("rep").alias("a"), F.col("pivot").alias("b")).agg(F.max("members").alias("members"))
    best = likely(first.select("a", "b", parts_of("members")), reps, percent)
    best = staged(best.groupBy("a").agg(F.min(F.struct("z", "b", "parts")).alias("x")).select("a", "x.b", "x.parts"), "pivots")
    # A doc_id with several texts ties their classes together.
    again = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    again = filled.select("doc_id", "k1", "k2").join(again, "doc_id").join(classes, ["k1", "k2"])
    labels = components(linked(best, texts, size, percent).unionByName(again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))

    # Then whatever could still join two components.
    for turn in range(PIVOT_ROUNDS + 1):
        rows = met.select("band", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
        parts = rows.groupBy("band", "label").agg(F.count("*").alias("k")).groupBy("band")
        parts = parts.agg(F.count("*").alias("parts"), F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("squares")).where("parts > 1")
        rows = staged(rows.join(parts, "band").drop("parts"), "mixed-bands")
        told = rows.agg(F.count("*").alias("n"), F.sum((F.col("all") - F.col("squares") / F.col("all")) / 2).alias("pairs")).first()
        if not told["n"]:
            break
        whole = told["pairs"] <= PAIRS_A_ROW * told["n"] or turn == PIVOT_ROUNDS
        if whole:
            with_marks = rows.select("band", "rep", "label", "all").join(reps.select("rep", "n", "sketch", "parity"), "rep")
            pairs = met_in_tiles(with_marks, percent)
            pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.all").alias("all"))
            pairs = pairs.groupBy("a", "b").agg(F.max("all").alias("all")).select("a", "b", parts_of("all"))
        else:
            pick = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "label")).alias("p"))
            pick = pick.select("band", F.col("p.rep").alias("b"), F.col("p.label").alias("of"))
            pairs = rows.join(pick, "band").where("label != of").groupBy(F.col("rep").alias("a"), "b").agg(F.max("all").alias("all"))
            pairs = likely(pairs.select("a", "b", parts_of("all")), reps, percent).select("a", "b", "parts")
        pairs = staged(pairs, "pairs")
        found = staged(linked(pairs, texts, size, percent), "links")
        if not found.isEmpty():
            old = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = components(old.unionByName(found))
        discard(rows, pairs, found)
        if whole:
            break
    discard(met, reps, texts, best)

    named = known.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    named = named.withColumn("rep", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")))
    out = named.join(labels, F.col("rep") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def alike(x: str, y: str, percent: int = PERCENT) -> Column:
    """Whether sizes and bitmaps of two rows allow a link."""
    m, n = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = F.least(m, n) * 100 >= F.greatest(m, n) * percent
    near = differing(F.col(f"{x}.parity"), F.col(f"{y}.parity"), PARITY_BITS) * (100 + percent) <= (m + n) * (100 - percent)
    return fits & near & (differing(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"), SKETCH_BITS) <= most_differing(percent))


def met_in_tiles(rows: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Pairs (x, y) of one band and of different labels, x's the smaller, whose bitmaps allow a link.

    rows: (band, rep, label, all, n, sketch, parity), ``all`` being the rows of the band. A
    band is cut into p parts by a hash, and each row goes to the p tiles of its part: as x
    along one side, as y along the other. So a hot band is many small joins, not one.
    """
    p = F.greatest(F.lit(1), F.ceil(F.col("all") / tile)).cast("int")
    part = F.pmod(F.xxhash64("rep"), p).cast("int")
    others = F.explode(F.sequence(F.lit(0), p - 1))
    x = rows.withColumn("row", part).withColumn("col", others).alias("x")
    y = rows.withColumn("col", part).withColumn("row", others).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "row", "col")]
    return x.join(y, same[0] & same[1] & same[2] & (F.col("x.label") < F.col("y.label")) & alike("x", "y", percent))


def differing(x: Column, y: Column, bits: int) -> Column:
    """Population count of the XOR of two bitmaps."""
    out = F.lit(0)
    for i in range(bits // 64):
        out = out + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return out


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, parts) that sizes and sketches allow, with z."""
    marks = lambda key, name: reps.select(F.col("rep").alias(key), F.struct("n", "sketch", "parity").alias(name))
    both = dealt(pairs.join(marks("a", "x"), "a"), marks("b", "y")).where(alike("x", "y", percent))
    return both.select("a", "b", "parts", differing(F.col("x.sketch"), F.col("y.sketch"), SKETCH_BITS).alias("z"))


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents by 2-word shingles; see the module."""
    return grouped(table(spark, sf_dir, "documents", "doc_id", "text"), 2)
