"""The pipeline, stage by stage."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from pulseloom.llm import mixing, near_dedup, quality
from test_corpus import brute, plain_components


def test_stages_over_odd_and_empty_documents(spark, tables):
    for name, d in tables.items():
        docs = spark.read.parquet(f"{d}/documents.parquet")
        columns = docs.columns
        for i, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, d)
            if i < len(P.STAGES) - 1:
                assert out.columns == columns
                out = spark.createDataFrame(out.collect(), docs.schema)
            docs = out
        assert (docs.count() == 0) == (name == "empty")


def test_run_equals_plain_stages(spark, sf_dir):
    """Accepted documents, roots of all-pairs components, no item at any offset, the mix of just these, and a shard for each."""
    got = P.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in quality.op2_quality_trees(spark, sf_dir).collect() if r["predicted"]}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    roots = {i for i, c in plain_components(rows, 5).items() if i == c}
    tok = lambda t: [w for w in re.split(r"[^\w]+|_+", t.lower()) if w]
    items = [(r["item_id"], tok(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute([(i, tok(t)) for i, t in rows if i in roots], items)}
    left = docs.where(F.col("doc_id").isin(list(roots - bad)))
    want = {r["doc_id"]: r["copies"] for r in mixing.mixed(left).select("doc_id", "mix.copies").collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in got) == want and bad and len(roots) < len(kept)
    assert all(r["shard"] and r["version"] for r in got)


def test_rows_are_judged_by_their_own_texts(spark, tables, odd):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, item), (1, "something else"), (None, item), (None, "nothing of it"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = tables["odd"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    real = P.table
    try:
        P.table = lambda s, sf, name, *c: bench if name == "benchmark" else real(s, sf, name, *c)
        got = P.decontaminate(spark, docs, d).collect()
    finally:
        P.table = real
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "something else"), (None, "nothing of it"), (None, None), (2, "")]))
    same_id = spark.createDataFrame([(5, f"text {i} of its own") for i in range(20)] + [(5, None)], "doc_id long, text string")
    firsts = {P.near_dedup(spark, same_id.repartition(n, "text"), d).collect()[0]["text"] for n in (1, 3, 7)}
    assert len(firsts) == 1


def test_one_row_of_repeated_rows_stays(spark, odd):
    got = P.near_dedup(spark, odd, "").collect()
    ids = [r["doc_id"] for r in got]
    assert ids.count(1) == 1 and None in ids and 6 not in ids and 9 not in ids and {2, 3, 4, 5, 8} <= set(ids)
    assert near_dedup.grouped(odd, 5).count() == 15
