"""A corpus, from documents to shards: the stages, and their run over a folder of tables.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps of ``docs``. Texts are read whole, however long. All but the last return the columns of ``docs``, whatever they are;
names that begin with two underscores are taken by the stages. Each stage gives an empty
table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import remove, shared_dir, table
from pulseloom.llm.decontamination import contaminated
from pulseloom.llm.mixing import mixed
from pulseloom.llm.near_dedup import grouped
from pulseloom.llm.quality import KEEP_AT, fit, scored, usable_for_fit
from pulseloom.llm.sharding import sharded

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null, empty and blank texts have the statistics of an empty text; very long ones are
    read whole; equal texts, and so repeated rows, are kept or go together. Rows with a
    null doc_id are scored like any others and never learned from. Without labels of both
    classes all scores are the prior.
    """
    trees = fit(docs, table(spark, sf_dir, "labels"), usable_for_fit())
    return scored(docs, trees, "__quality").where(F.col("__quality") >= KEEP_AT).drop("__quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Null, empty and blank texts are like nothing and stay, as do rows with a null doc_id. Of
    several rows with one doc_id, repeated or with different texts, one stays: that whose
    columns as JSON have the smallest digest, so that reruns agree.
    """
    kept = grouped(docs, SHINGLE).where("kept").select(F.col("doc_id").alias("__kept"))
    once = kept.where(F.col("__kept").isNotNull()).groupBy("__kept").agg(F.count("*").alias("__rows"))
    rows = docs.join(once, docs["doc_id"] == F.col("__kept"), "left").where(docs["doc_id"].isNull() | F.col("__kept").isNotNull())
    row = F.struct(*[docs[c] for c in docs.columns])
    repeated = rows.where(F.col("__rows") > 1).groupBy("__kept").agg(F.min_by(row, F.md5(F.to_json(row))).alias("__row"))
    single = rows.where(F.coalesce("__rows", F.lit(1)) == 1).select(*[docs[c] for c in docs.columns])
    return single.unionByName(repeated.select("__row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds nothing of the benchmark.

    A text is judged by itself, not by its doc_id: rows without one, and rows that share
    one, stay or go each by its own text. Null and empty texts, and items without a token
    or without an item_id, match nothing; repeated rows stay or go together.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("doc_id"), "text")
    found = contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(found, F.md5(docs["text"]) == F.col("__hit"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or twice.

    Null, empty and blank texts have no words and stay once; a null source is a source of
    its own. Which of several rows with the same doc_id and number of words is repeated
    does not matter to the mix.
    """
    out = mixed(docs, column="__mix")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__mix.copies").cast("int"))).alias("__copy")
    return out.select(*docs.columns, copies).drop("__copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in a store of compacted shards, which holds all columns as they are, nulls and repeated rows too."""
    return sharded(docs).placed(column="__placed").select("doc_id", "__placed.*")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL can't express the trees, the rounding to copies, or the shards; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder, read again, and removed after the next."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{i}")
        if before:
            remove(spark, before)
        before = f"{folder}/{i}"
        docs = spark.read.parquet(before)
    return docs
