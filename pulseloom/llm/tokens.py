"""Token counts of a byte-level BPE tokenizer: a map-side two-tier lookup.

A text is cut into pre-tokens in the worker. The first tier is a broadcast table of the
lengths of the TABLE most frequent pre-tokens, counted in a random sample of about SAMPLE
documents (all of a smaller corpus). What it lacks is encoded by the tokenizer's model once
and kept in a bounded cache of the worker, the second tier. No pre-token of the corpus is
ever shuffled, only the sample's counts, summed in the workers first. The sample decides on
speed alone: any table gives the same lengths.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); very long texts are
counted whole; repeated rows, and rows without a doc_id, are counted each; a special
string inside a text is one token, as the library handles it by default.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter as Tally
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseloom.llm.common import table

#: Pre-tokens that a worker remembers at most; beyond it, it starts anew.
CACHE = 300_000
#: Entries of the broadcast table at most.
TABLE = 100_000
#: Documents, about, in which its pre-tokens are counted.
SAMPLE = 20_000
#: Longest pre-token that is worth remembering, in code points.
LONGEST = 64
LIMIT = 1024
#: Pre-tokens of byte-level BPE: fixed by the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORKER: dict[str, "Counter"] = {}


def default_tokenizer() -> str:
    """The vocabulary file, read on the driver and sent to the workers as text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


class Lengths(dict):
    """Lengths of pre-tokens: the frequent ones for good, others until CACHE of them are held."""

    def __init__(self, frequent: dict[str, int], encode) -> None:
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE writes each byte: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens of texts; one of each table lives in a worker."""

    def __init__(self, tokenizer: str, table: dict[str, int]) -> None:
        whole = Tokenizer.from_str(tokenizer)
        merge, letters = whole.model.tokenize, byte_letters()
        self.encode = lambda piece: len(merge(piece.encode().decode("latin-1").translate(letters)))
        self.lengths = Lengths(table, self.encode)
        special = [x["content"] for x in json.loads(tokenizer)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut = regex.compile(PATTERN).findall

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.lengths.__getitem__, self.cut(text)))

    def count(self, text: str | None) -> int:
        text = text or ""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


def tallied(texts: DataFrame) -> DataFrame:
    """(piece, n): how often each pre-token of up to LONGEST code points occurs in the column ``text``; workers sum up first."""
    cut = regex.compile(PATTERN)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Tally = Tally()
        for b in batches:
            for text in b["text"]:
                held.update(p for p in cut.findall(text) if len(p) <= LONGEST)
                if len(held) > CACHE:
                    yield pd.DataFrame(held.items(), columns=["piece", "n"])
                    held.clear()
        if held:
            yield pd.DataFrame(held.items(), columns=["piece", "n"])

    parts = texts.select("text").where("text IS NOT NULL").mapInPandas(of, "piece string, n long")
    return parts.groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, tokenizer: str, entries: int = TABLE, sample: int = SAMPLE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``sample`` documents that occur there more than once: at most ``entries``, each of at most LONGEST code points."""
    share = sample / max(1, docs.count())
    some = docs if share >= 1 else docs.sample(share, seed=sample)
    top = tallied(some).where("n > 1").orderBy(F.desc("n"), "piece").limit(entries).select("piece").collect()
    length = Counter(tokenizer, {}).encode
    return {r["piece"]: length(r["piece"]) for r in top}


def counted(docs: DataFrame, tokenizer: str | None = None, column: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; a column of that name is replaced."""
    tokenizer = tokenizer or default_tokenizer()
    held = docs.sparkSession.sparkContext.broadcast((tokenizer, frequent(docs, tokenizer)))
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Counter(*held.value)
        for b in batches:
            yield pd.Series([_WORKER[key].count(t) for t in b], dtype="int64")

    return docs.withColumn(column, of.asNondeterministic()(F.col("text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; see the module for nulls and special strings."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return counted(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
