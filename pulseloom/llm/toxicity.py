"""Toxic spans and scores: a linear-chain conditional random field over tokens.

Documents carry labels, tokens do not, so token labels are derived first. A token has as
features its word and the beginnings of it; a feature that occurs clearly more often in
toxic than in clean training documents, in many different neighbourhoods, is marked, and
the tokens of toxic documents that have a marked feature are labelled toxic, all others
clean. The field has a weight for each known feature, a bias, and transitions between the
two states; it is fitted by maximum likelihood on a bounded sample of whole labelled
documents. Forward-backward marginals give the offending offsets, and a logistic layer
over their sum, maximum and count gives the score of the document.

One step of a recursion advances all documents of a batch at once; texts go in whole,
whatever their length.

Defined results: null, empty and wordless texts have no spans and get the score of a
text without evidence; without labels of both classes every score is the prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import fold, table

#: Labelled documents of each class that a fit takes at most.
FIT_ROWS = 2_000
#: Tokens of a batch that one recursion takes together; longer texts still go in whole.
CHUNK_TOKENS = 400_000
STEPS, L2, SPAN_AT, TOXIC_AT = 20, 1.0, 0.5, 0.7
_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(raw: str) -> str:
    """A token without case and without the punctuation around it."""
    return _EDGES.sub("", raw.lower())


def features(word: str) -> list[str]:
    """The word as a whole, and its beginnings of 3 to 8 code points."""
    return [f"={word}", *(word[:i] for i in range(3, min(len(word), 8) + 1))]


def marginals(unary: np.ndarray, trans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the expected number of each pair of neighbouring states.

    unary: log-odds of toxic for the concatenated tokens; trans: 2x2 potentials; document
    i has the tokens from starts[i] to ends[i]. Messages are kept as ratios of the two
    states, and one step advances all documents that are long enough.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    (t00, t01), (t10, t11) = trans
    u = np.exp(np.clip(unary, -30, 30))
    ahead, behind = u.copy(), np.ones(n)
    order = np.argsort(starts - ends, kind="stable")
    s, size = starts[order], (ends - starts)[order]
    longer = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # documents with more than t tokens
    r = None
    for t in range(size[0]):
        k = longer[t]
        at = s[:k] + t
        r = u[at] if r is None else u[at] * (t01 + t11 * r[:k]) / (t00 + t10 * r[:k])
        ahead[at] = r
    for t in range(size[0] - 1, 0, -1):
        at = s[: longer[t]] + t
        x = u[at] * behind[at]
        behind[at - 1] = (t10 + t11 * x) / (t00 + t01 * x)
    odds = ahead * behind
    inner = np.ones(n, bool)
    inner[starts[starts < ends]] = False
    i = np.flatnonzero(inner)
    a, e = ahead[i - 1], u[i] * behind[i]
    total = t00 + t01 * e + (t10 + t11 * e) * a
    pairs = np.array([[(t00 / total).sum(), (t01 * e / total).sum()], [(t10 * a / total).sum(), (t11 * a * e / total).sum()]])
    return odds / (1 + odds), pairs


@dataclass
class Field:
    """A fitted field: weights by feature, bias, transitions, and the layer over documents."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.full((2, 2), 0.5))
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all tokens of the texts, and where each text ends."""
        memo, seen, ends, weight_of = self.__dict__.setdefault("_memo", {}), [], [], self.weights.get
        for text in texts:
            raw = (text or "").split()
            for w in set(raw).difference(memo):
                memo[w] = self.bias + sum(weight_of(f, 0.0) for f in features(normal(w)))
            seen += map(memo.__getitem__, raw)
            ends.append(len(seen))
            if len(memo) > 500_000:
                memo.clear()
        return np.array(seen, float), np.array(ends, np.int64)

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Marginals of each text's tokens, and the scores of the texts."""
        unary, ends = self.tokens(texts)
        starts = np.append(0, ends[:-1]).astype(np.int64)
        toxic, _ = marginals(unary, self.trans, starts, ends)
        each = [toxic[a:b] for a, b in zip(starts, ends, strict=True)]
        x = np.array([evidence(m) for m in each]).reshape(len(each), 4)
        return each, 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30)))


def evidence(m: np.ndarray) -> tuple[float, float, float, float]:
    """What a document's marginals amount to, for the layer over documents."""
    return 1.0, math.log1p(m.sum()) if len(m) else 0.0, float(m.max()) if len(m) else 0.0, math.log1p(len(m)) / 10


def spans(text: str | None, m: np.ndarray, at: float = SPAN_AT) -> list[tuple[int, int]]:
    """Code-point spans of the toxic tokens; neighbouring ones are joined."""
    out: list[tuple[int, int]] = []
    if not len(m) or m.max() < at:
        return out
    open_ = False
    for w, p in zip(_TOKEN.finditer(text or ""), m, strict=False):
        if p < at:
            open_ = False
        elif open_:
            out[-1] = (out[-1][0], w.end())
        else:
            out.append(w.span())
            open_ = True
    return out


def train(texts: list[str], y: np.ndarray, prior: float) -> Field:
    """Fit tokens, transitions and layer. prior: share of toxic rows among all usable labels."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    shift = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not n1 or not n0:
        return Field(layer=np.array([shift if len(y) else 0.0, 0, 0, 0]))
    # Documents as arrays of places in the list of distinct words.
    place: dict[str, int] = {}
    raw: dict[str, int] = {}
    docs = []
    for text in texts:
        words = text.split()
        for w in set(words).difference(raw):
            raw[w] = place.setdefault(normal(w), len(place))
        docs.append(np.fromiter(map(raw.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(docs)
    of_word = [features(w) if w else [] for w in place]
    toxic_in, clean_in = Counter(), Counter()
    for words, label in zip(docs, y, strict=True):
        (toxic_in if label else clean_in).update({f for w in np.unique(words).tolist() for f in of_word[w]})

    def apart(k: int, c: int, least: float, surely: float) -> bool:
        """Whether k against c occurrences, by the sizes of the classes, are at least ``least`` to 1, and surely above ``surely`` to 1."""
        ratio = math.log((k + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
        return k >= 5 and ratio > math.log(least) and ratio - 2.0 * math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5)) > math.log(surely)

    # By documents first, and loosely: a language of few toxic documents has its features diluted by all the others.
    marked = {f for f, k in toxic_in.items() if apart(k, clean_in[f], 4, 1.5)}
    # Copies repeat a text around a token; only distinct neighbourhoods count as evidence.
    suspect = [[f for f in fs if f in marked] for fs in of_word]
    around: tuple[dict, dict] = ({}, {})
    any_suspect = np.array([bool(fs) for fs in suspect], bool)
    for words, label in zip(docs, y, strict=True):
        for i in np.flatnonzero(any_suspect[words]).tolist():
            beside = (int(words[i - 1]) if i else -1, int(words[i + 1]) if i + 1 < len(words) else -1)
            for f in suspect[words[i]]:
                around[int(label)].setdefault(f, set()).add(beside)
    marked = {f for f in marked if apart(len(around[1].get(f, ())), len(around[0].get(f, ())), 10, 3)}
    counts = np.bincount(ids, minlength=len(place))
    total = Counter()
    for fs, k in zip(of_word, counts.tolist(), strict=True):
        for f in fs:
            total[f] += k
    known = {f: i for i, f in enumerate(sorted(f for f, k in total.items() if f in marked or (f[0] == "=" and k >= 50)))}
    # Incidence of words and known features; the bias is feature 0 of every word.
    cells = [(i, known[f] + 1) for i, fs in enumerate(of_word) for f in fs if f in known] + [(i, 0) for i in range(len(place))]
    row, col = np.array(cells).T
    heavy = np.array([any(f in marked for f in fs) for fs in of_word])
    truth = np.repeat(y > 0, [len(d) for d in docs]) & heavy[ids]
    ends = np.cumsum([len(d) for d in docs])
    starts = np.append(0, ends[:-1]).astype(np.int64)
    weight, trans = np.zeros(len(known) + 1), np.zeros((2, 2))
    weight[0] = -8.0
    for f in marked:
        weight[known[f] + 1] = 3.0
    by_feature = lambda v: np.bincount(col, v[row], len(weight))
    inner = np.ones(len(ids), bool)
    inner[starts[starts < ends]] = False
    inner = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    seen = by_feature(counts)
    wanted = np.bincount(ids, truth, len(place))
    # Steps on the penalised likelihood, scaled by the curvature of each weight; features of a word share a step.
    for _ in range(STEPS):
        unary = np.bincount(row, weight[col], len(place))
        p, got = marginals(unary[ids], np.exp(trans), starts, ends)
        slope = by_feature(wanted - np.bincount(ids, p, len(place))) - L2 * weight
        curve = by_feature(np.bincount(ids, p * (1 - p), len(place))) + L2 + 0.02 * np.minimum(seen, 50)
        weight += np.clip(slope / curve / 3, -1, 1)
        trans += np.clip((pairs - got - 0.1 * trans) / (got * (1 - got / max(1, len(inner))) + 5), -0.5, 0.5)
    out = Field({f: float(weight[i + 1]) for f, i in known.items()}, float(weight[0]), np.exp(trans - trans.max()))
    p, _ = marginals(np.bincount(row, weight[col], len(place))[ids], out.trans, starts, ends)
    x = np.empty((len(docs), 4))
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        x[i] = evidence(p[a:b])
    # Classes were taken at other rates than they have; weights restore these.
    rate = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    beta = np.zeros(4)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (rate * (y - s)) - 0.01 * beta
        beta += np.linalg.solve((x * (rate * s * (1 - s) + 1e-9)[:, None]).T @ x + 0.01 * np.eye(4), slope)
    out.layer = beta
    return out


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS) -> Field:
    """A field from at most ``rows`` usable labelled documents of each class, by lowest hash of the id."""
    held = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = held.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    )
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return train(got["text"].tolist(), got["y"].to_numpy(float), prior)


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive whole texts of about CHUNK_TOKENS tokens together."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "") // 5
        if size >= CHUNK_TOKENS:
            yield part
            part, size = [], 0
    if part:
        yield part


def scored(docs: DataFrame, model: Field, column: str = "toxicity") -> DataFrame:
    """``docs`` with struct ``column``: score, n_toxic tokens, and spans (start, end) in code points; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_toxic long, spans array<array<int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for part in chunks(b.tolist()):
                each, score = held.value.read(part)
                rows += [(float(s), int((m >= SPAN_AT).sum()), [list(x) for x in spans(t, m)]) for t, m, s in zip(part, each, score, strict=True)]
            yield pd.DataFrame(rows, columns=["score", "n_toxic", "spans"])

    return docs.withColumn(column, of.asNondeterministic()(F.col("text")))


def usable_for_fit() -> Column:
    """Rows that a fit may learn from: crc32(doc_id) mod 3 is not 1."""
    return fold("doc_id", 3) != 1


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; see the module for null, empty and repeated rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), usable_for_fit())
    return scored(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.col("toxicity.n_toxic").alias("n_toxic"),
        F.to_json("toxicity.spans").alias("spans"),
    )
