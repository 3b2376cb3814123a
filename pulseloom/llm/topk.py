"""Exact top-k search by inner product: block-at-a-time pruning.

Vectors are stored as blocks, ranges of documents that lie together, each with a forward
index (the vectors of the block) and a summary: the largest and smallest value of each
term, the block's middle, and its radius around that. A query's bound for a block is the
sum over its terms of the largest product that the block allows, or, where that is less,
its product with the middle plus the radius times its own length.

Which vectors lie together comes from centres, fitted on a bounded sample of the vectors;
every vector goes to the block of its nearest centre, whatever the centres are, so that
they decide on speed only. A centre with very many vectors has them dealt to several
tasks.

A search has three passes. Each query is scored against one block of its own centre, which
gives it a floor for its k-th score. Packs of queries are then held against summaries
only; of a pack and a block stays what some query of the pack can't rule out. Last, each
pack takes the blocks that are left in descending order of bounds, scores them through
their forward indexes, and each of its queries stops at the block whose bound falls below
its k-th best score so far. A block whose bound equals the k-th score is still scored,
since ties go to smaller ids. No pass gathers more than a pack and a run of blocks.

How much is pruned is a matter of the vectors: :func:`surviving` tells. Where vectors lie
in clusters most blocks go; where they point evenly into all directions of many
dimensions, the k-th score lies below the bound of any block that holds more than one
vector, nothing goes, and the search scores all.

Components x become floor(256 x). Scores are exact: products are summed in doubles while
all partial sums stay below 2 ** 53, else in 64-bit integers.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part, neither do rows with a null vec_id; a shorter vector counts as padded with
zeros; a query's own rows are all those with its vec_id; repeated rows (same vec_id and
vector) count once; a vec_id that asks with several vectors has its results merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import arrow_rows, discard, staged, table

K, SCALE = 5, 256
#: Vectors of a block, summaries of a run, queries of a pack: what a task holds at once.
BLOCK, RUN, PACK = 256, 256, 512
#: Vectors and centres of a fit, components that the sample may have in all, rounds; vectors that one task puts into blocks; tasks for one pack.
SAMPLE, CENTRES, COMPONENTS, ROUNDS, CELL, SHARES = 4096, 128, 4_000_000, 6, 65_536, 64
_PACKED = "cell int, salt int, part int, at int, n int, dims int, ids binary, mat binary, high binary, low binary, mid binary, radius double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): usable rows, with whole components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def matrix(vectors: list, dims: int | None = None) -> np.ndarray:
    """Vectors as rows, cut or padded with zeros to ``dims``, by default the longest."""
    dims = dims or max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:dims]
    return out


def centres(rows: DataFrame) -> np.ndarray:
    """Centres of a bounded sample, the rows of lowest hash, by a few rounds of k-means; one for four blocks of rows at most."""
    count, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return np.zeros((1, 1))
    n = max(1, min(SAMPLE, COMPONENTS // widest))
    got = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(n).select("v").collect()
    x = matrix([r["v"] for r in got]).astype(float)
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[: min(CENTRES, max(1, count // (4 * BLOCK)), len(x))]]
    for _ in range(ROUNDS):
        at = nearest(x, c)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def celled(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, v) with ``cell``, the nearest centre."""
    held = rows.sparkSession.sparkContext.broadcast(c)  # CENTRES x dims at most, and no more than COMPONENTS

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(list(b["v"]), held.value.shape[1]).astype(float)
                yield b.assign(cell=nearest(x, held.value).astype(np.int32))

    return rows.mapInPandas(of, "vec_id long, v array<long>, cell int")


def narrow(m: np.ndarray) -> bytes:
    """A matrix in the smallest width that holds it, named in its first byte."""
    top = int(np.abs(m).max(initial=0))
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "q"
    return kind.encode() + m.astype(kind).tobytes()


def array(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, raw[:1].decode(), offset=1).astype(np.int64).reshape(-1, dims)


def packed(rows: DataFrame, size: int, cells: int = CENTRES) -> DataFrame:
    """Rows (vec_id, v, cell) as blocks of at most ``size``; a block's vectors are of one cell where rows are many enough.

    A cell of many rows is dealt to several salts. ``cells``: how many there are.
    """
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each centre
    wide = max(1, cells * size // max(1, sum(counts.values())))  # cells that share a block
    salts = [(cell, -(-n // CELL)) for cell, n in counts.items()]
    salts = F.element_at(F.create_map(*[F.lit(x) for kv in salts for x in kv]), F.col("cell")) if salts else F.lit(1)
    rows = rows.withColumns({"salt": F.pmod(F.xxhash64("vec_id"), salts).cast("int"), "group": F.floor(F.col("cell") / wide).cast("int")})

    def blocks(rows: list, ids: list, cell: int, salt: int, part: int, at: int) -> tuple:
        m, ids = matrix(rows), np.array(ids, np.int64)
        mid = np.rint(m.mean(axis=0)).astype(np.int64)
        radius = float(np.sqrt(((m - mid).astype(float) ** 2).sum(axis=1).max()))
        return (cell, salt, part, at, len(m), m.shape[1], ids.tobytes(), narrow(m), narrow(m.max(axis=0)), narrow(m.min(axis=0)), narrow(mid), radius)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at, key, first, salt_of, vs, ids, out = TaskContext.get().partitionId(), 0, None, 0, 0, [], [], []
        for b in batches:
            for vec_id, v, cell, salt, group in zip(b["vec_id"], b["v"], b["cell"], b["salt"], b["group"], strict=True):
                if vs and (key != (group, salt) or len(vs) == size):
                    out.append(blocks(vs, ids, first, salt_of, part, at))
                    at, vs, ids = at + 1, [], []
                if not vs:
                    first, salt_of = cell, salt
                key = (group, salt)
                vs.append(v)
                ids.append(vec_id)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if vs:
            yield pd.DataFrame([blocks(vs, ids, first, salt_of, part, at)], columns=names)

    names = [x.split()[0] for x in _PACKED.split(", ")]
    # A cell's rows go in order of their leading term, so that its blocks differ.
    lead = F.array_position(F.transform("v", lambda x: F.abs(x)), F.array_max(F.transform("v", lambda x: F.abs(x))))
    dealt = rows.repartition("group", "salt").withColumn("lead", F.struct(lead, F.element_at("v", lead.cast("int"))))
    return dealt.sortWithinPartitions("group", "salt", "cell", "lead", "vec_id").drop("lead").mapInPandas(of, _PACKED)


def fitted(m: np.ndarray, dims: int) -> np.ndarray:
    """A matrix cut or padded with zeros to ``dims`` columns."""
    return m[:, :dims] if m.shape[1] >= dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by score, then by smaller id; an id counts once a row."""
    order = np.lexsort((ids, -scores), axis=1)
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (scores[:, 1:] == scores[:, :-1])
    if again.any():
        scores = np.where(again, NONE, scores)
        order = np.lexsort((ids, -scores), axis=1)
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    return scores[:, :k], ids[:, :k]


#: Stands for no score; its negative is a number too.
NONE = -np.iinfo(np.int64).max


@dataclass(frozen=True)
class Summary:
    """What is known of a block without its vectors."""

    block: str
    dims: int
    high: bytes
    low: bytes
    mid: bytes
    radius: float


def bounds(q: np.ndarray, summaries: list) -> np.ndarray:
    """The least proven bound of each query (row) for each block (column), never below a score that the block holds."""
    dims = q.shape[1]
    highs, lows, mids = (np.concatenate([fitted(array(getattr(s, c), s.dims), dims) for s in summaries]).astype(float) for c in ("high", "low", "mid"))
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    by_term = up @ highs.T + down @ lows.T
    ball = q.astype(float) @ mids.T + np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None] * np.array([s.radius for s in summaries])
    out = np.minimum(by_term, ball)
    # Sums in doubles may be off by their last digits.
    return out + np.abs(by_term) * 1e-9 + np.abs(ball) * 1e-9 + 1


def scores_of(q: np.ndarray, mat: np.ndarray) -> np.ndarray:
    """Inner products as exact integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(mat).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(float) @ mat.T.astype(float)).astype(np.int64) if largest < 2.0**53 else q @ mat.T


def taken(q: np.ndarray, qid: np.ndarray, kth: np.ndarray, bound: np.ndarray, block, scores: np.ndarray, ids: np.ndarray, k: int) -> int:
    """Score a block for the queries whose bound reaches their k-th score; best scores, ids and k-th scores change in place."""
    rows = np.flatnonzero(bound >= kth)
    if len(rows):
        mat, bid = fitted(array(block.mat, block.dims), q.shape[1]), np.frombuffer(block.ids, np.int64)
        got = np.where(qid[rows][:, None] == bid[None], NONE, scores_of(q[rows], mat))
        s, i = merge(np.concatenate([scores[rows], got], 1), np.concatenate([ids[rows], np.broadcast_to(bid, got.shape)], 1), k)
        scores[rows], ids[rows] = s, i
        kth[rows] = np.maximum(kth[rows], np.where(s[:, -1] == NONE, -np.inf, s[:, -1].astype(float)))
    return len(rows)


def found_in(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each pack's queries; a pack's own row comes first, then blocks, best bounds first."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def out() -> pd.DataFrame:
            _, qid, _, scores, ids = held
            r, c = np.nonzero(scores != NONE)
            return pd.DataFrame({"query_id": qid[r], "vec_id": ids[r, c], "score": scores[r, c]})

        for b in batches:
            for x in b.itertuples(index=False):
                if x.block is None:
                    if held:
                        yield out()
                    q, kth = array(x.mat, x.dims), np.frombuffer(x.bound, np.int64).astype(float)
                    held = [q, np.frombuffer(x.ids, np.int64), kth, np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)]
                else:
                    q, qid, kth, scores, ids = held
                    taken(q, qid, kth, np.frombuffer(x.bound, float), x, scores, ids, k)
        if held:
            yield out()

    return rows.mapInPandas(of, "query_id long, vec_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def floors(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``asked`` packs with q_floor: of each query the k-th score in the fullest block of its pack's cell, NONE where that has fewer."""
    cells = blocks.groupBy("cell").agg(F.max(F.struct("n", "salt", "part", "at")).alias("x"))  # a row for each centre
    one = blocks.join(F.broadcast(cells.select("cell", "x.salt", "x.part", "x.at")), ["cell", "salt", "part", "at"])
    pairs = asked.join(one.select("cell", "dims", "ids", "mat"), asked["q_cell"] == one["cell"], "left").drop("cell")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                q, qid = array(x.q_mat, x.q_dims), np.frombuffer(x.q_ids, np.int64)
                scores, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
                if x.mat is not None:
                    taken(q, qid, np.full(len(q), -np.inf), np.zeros(len(q)), x._replace(dims=int(x.dims)), scores, ids, k)
                rows.append((x.pack, x.q_dims, x.q_ids, x.q_mat, scores[:, -1].tobytes()))
            yield pd.DataFrame(rows, columns=["pack", "q_dims", "q_ids", "q_mat", "q_floor"])

    return pairs.mapInPandas(of, "pack string, q_dims int, q_ids binary, q_mat binary, q_floor binary")


def surviving(packs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pack, block, bound, best, open, queries): what no summary rules out; bound holds one double for each query of the pack.

    Packs meet runs of summaries by the number of the run: the stated queries against all
    rows, in blocks, without a look at any vector.
    """
    summary = F.struct("block", "dims", "high", "low", "mid", "radius")
    runs = blocks.groupBy("run").agg(F.collect_list(summary).alias("summaries"))
    n = blocks.agg(F.max("run")).first()[0]
    n = -1 if n is None else n
    met = packs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(max(n, 0))))).join(runs, "run")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                summaries = [Summary(**(s if isinstance(s, dict) else s.asDict())) for s in x.summaries]
                q, floor = array(x.q_mat, x.q_dims), np.frombuffer(x.q_floor, np.int64).astype(float)
                got = bounds(q, summaries)
                open_ = got >= floor[:, None]
                keep = np.flatnonzero(open_.any(axis=0))
                if not len(keep):
                    continue
                yield pd.DataFrame({
                    "pack": [x.pack] * len(keep), "block": [summaries[j].block for j in keep], "bound": [got[:, j].tobytes() for j in keep],
                    "best": got[:, keep].max(axis=0), "open": open_[:, keep].sum(axis=0), "queries": [len(q)] * len(keep),
                })

    return met.mapInPandas(of, "pack string, block string, bound binary, best double, open long, queries long")


def indexed(vectors: DataFrame, queries: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The packs with their floors, the blocks, and the staged tables behind them."""
    spark = vectors.sparkSession
    c = centres(usable(vectors))
    rows, asking = (staged(celled(usable(df), c), "celled") for df in (vectors, queries))
    with arrow_rows(spark, 1024):
        blocks, packs = staged(packed(rows, BLOCK, len(c)), "blocks"), staged(packed(asking, PACK, len(c)), "packs")
    name = F.concat_ws("-", "part", "at")
    asked = packs.select(
        name.alias("pack"), F.col("cell").alias("q_cell"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat")
    )
    with arrow_rows(spark, 16):
        told = staged(floors(asked, blocks, k), "floors")
    # Blocks of a part are numbered on from those of the parts before.
    parts = blocks.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = blocks.join(F.broadcast(parts), "part").withColumn("run", F.floor((F.col("before") + F.col("at")) / RUN).cast("int"))
    return told, numbered.withColumn("block", name), [rows, asking, blocks, packs, told]


def searched(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``, both (vec_id, embedding)."""
    spark = vectors.sparkSession
    packs, blocks, held = indexed(vectors, queries, k)
    with arrow_rows(spark, 1):
        pairs = staged(surviving(packs, blocks).select("pack", "block", "bound", "best"), "pairs")
    # A pack goes once to each task that has a share of its blocks, ahead of these.
    rows = pairs.join(blocks.select("block", "dims", "ids", "mat"), "block").withColumn("share", F.pmod(F.xxhash64("block"), F.lit(SHARES)))
    own = packs.join(rows.select("pack", "share").distinct(), "pack")
    own = own.select("pack", "share", F.lit(None).cast("string").alias("block"), F.col("q_floor").alias("bound"), F.lit(None).cast("double").alias("best"), F.col("q_dims").alias("dims"), F.col("q_ids").alias("ids"), F.col("q_mat").alias("mat"))
    met = own.unionByName(rows).repartition("pack", "share")
    met = met.sortWithinPartitions("pack", "share", F.col("best").desc_nulls_first())
    with arrow_rows(spark, 16):
        found = staged(found_in(met.select("block", "bound", "dims", "ids", "mat"), k), "found")
    discard(pairs, *held)
    return best(found, k)


def op10_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each query (vec_id divisible by 50); see the module."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return searched(rows, rows.where(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")
