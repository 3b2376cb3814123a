"""Documents with every oddity, for all operators and stages."""

from __future__ import annotations

import pytest

PROSE = "The quiet harbour kept its boats close to the stones while gulls argued over the last of the bread and nobody minded the rain that fell on the long wooden pier"
LONG = " ".join(f"word{i % 997} of{i % 31} many{i % 7}" for i in range(20_000))
ODD = [
    (1, PROSE, "en", "s1", 150), (1, PROSE, "en", "s1", 150), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \n\t\x0b ", "en", "", 4),
    (None, "a text without a number of its own", "en", "s2", 30), (5, LONG, "en", "s2", len(LONG)), (6, PROSE.upper(), "en", "s2", 150), (7, PROSE + " today", "en", None, 156),
    (8, "word", "en", "s3", 4), (9, "word", "en", "s3", 4), (10, "naïve café 😀 <|endoftext|> don't  stop\n\n\nnow 12345", "fr", "s3", 50), (11, "a" * 50_000, "en", "s3", 50_000),
    (12, "two words", "en", "s1", 9), (12, "other words entirely", "en", "s1", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHING = ["score", "size", "label", "rep", "n", "a", "b", "band", "mix", "placed", "shard", "version", "_kept", "_key", "_size", "_row", "copies", "predicted", "template", "start", "seed", "place"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, odd, empty):
    """Folders of tables: the odd documents, and none."""
    out = {}
    for name, docs in (("odd", odd), ("empty", empty)):
        d = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{d}/documents.parquet")
        labels = [(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, None), (99, 0, 0)]
        spark.createDataFrame(labels if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        bench = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "no id here at all but many words that could match something"), (4, "short item")]
        spark.createDataFrame(bench if name == "odd" else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        vectors = [(0, [0.1, -0.2, 0.3]), (0, [0.1, -0.2, 0.3]), (50, [0.1, -0.2]), (1, None), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, []), (6, [0.1, -0.2, 0.3]), (None, [1.0]), (100, [0.0, 0.0, 0.0]), (7, [3e4, 1.0, 1.0])]
        spark.createDataFrame(vectors if name == "odd" else [], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        out[name] = d
    return out
