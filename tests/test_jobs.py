"""The jobs: against SQL, rerun, over growing input, and from the command line."""

from __future__ import annotations

import json
import logging
import os
import subprocess
import sys
from collections import Counter

import pytest

from compare import same
from jobs import annotation_notes, queries, training_set
from jobs.common import settings
from pulseloom.functions.columns import SEIZURE_CODES, SEIZURE_WORDS
from pulseloom.operators import windows
from pulseloom.plans import training

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_job_equals_sql(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name]))


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# -- training set --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("training"))
    return out, training_set.run(spark, "/root/testdata/sf0.01", out)


def test_a_rerun_changes_nothing(spark, built, tmp_path):
    out, rows = built
    before = rows_of(rows)
    spark.createDataFrame([(1,)], "left int").write.parquet(f"{out}/rows/split=train/shard=3", mode="append")  # of a run that broke off
    assert rows_of(training_set.run(spark, "/root/testdata/sf0.01", out)) == before


def test_training_set_is_scaled_by_its_training_split(spark, built):
    out, _ = built
    got = spark.read.parquet(f"{out}/rows").toPandas()
    assert set(got["split"]) == {"train", "val", "test"} and (got.groupby("rec")["split"].nunique() == 1).all()
    train = got[got["split"] == "train"]
    for n in ("RRMean_3", "SD1_5"):
        assert abs(train[n].mean()) < 1e-5 and abs(train[n].std(ddof=0) - 1) < 1e-5
    raw = spark.read.parquet(f"{out}/windows").select("rec", "window_start_time", "minute", "RRMean_3").toPandas()
    fit = {r["feature"]: r for r in spark.read.parquet(f"{out}/scaler").collect()}["RRMean_3"]
    both = got.merge(raw, on=["rec", "window_start_time", "minute"], suffixes=("", "_raw"))
    assert len(both) == len(got) and (abs(both["RRMean_3"] * fit["std"] + fit["mean"] - both["RRMean_3_raw"]) < 1e-3).all()
    assert {r["cls"] for r in spark.read.parquet(f"{out}/weights").collect()} == {0, 1, 2, 3}
    assert all(f.startswith("shard=") for f in os.listdir(f"{out}/rows/split=train") if not f.startswith((".", "_")))


def test_subjects_of_the_config_and_sequences(spark, built):
    out, _ = built
    rows = spark.read.parquet(f"{out}/windows")
    from pyspark.sql import functions as F

    made = training.assembled(rows, ["SD1_5"], F.col("subject"), fixed={"test": [3, 4]})
    assert {r["rec"] for r in made.rows.where("split = 'test'").select("rec").distinct().collect()} == {3, 4}
    seq = windows.sequences(made.rows, ["SD1_5"]).collect()
    assert seq and all(len(r["x"]) == len(r["final_mask"]) == 60 for r in seq)


# -- notes ---------------------------------------------------------------------------------


def screened(text):
    """(n_lines, n_events, first_event, words, codes) of one note, by loops."""
    lines = (text or "").split("\n")
    hits = [x.strip(" ").lower() in SEIZURE_CODES or any(w in x.strip(" ").lower() for w in SEIZURE_WORDS) for x in lines]
    split = (text or "").replace("\n", " ").replace("\t", " ").replace("\x0b", " ").split(" ")
    first = hits.index(True) + 1 if any(hits) else None
    return (
        sum(bool(x.strip(" \t\x0b\x0c\r")) for x in lines), sum(hits), first,
        ",".join(w for w in SEIZURE_WORDS if w in (text or "").lower()), ",".join(c for c in SEIZURE_CODES if c in split),
    )


def test_notes_equal_loops(spark):
    texts = [None, "", " \n\t", "Seizure at noon\nnothing\n 3.6 ", "code 1.1 and 7.4", "9.9", "FOCAL aware\n\nAbsence", "sz " * 30_000]
    docs = spark.createDataFrame([(i, t, "en", "a", f"x{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, words string").drop("words")
    got = {r["doc_id"]: tuple(r)[2:7] for r in annotation_notes.screened(docs).collect()}
    assert got == {i: screened(t) for i, t in enumerate(texts)} and got[3][1] == 2


def test_growing_input_is_taken_once(spark, sf_dir, tmp_path, caplog):
    """Copies of the documents arrive in two parts; each run takes only what is new."""
    caplog.set_level(logging.INFO, "jobs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4, "doc_id").cache()
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0")]
    parts[0].write.parquet(f"{tables}/documents.parquet")
    first = annotation_notes.run(spark, tables, out, {"max_files": 1})
    assert first.count() == parts[0].count() and f"read {first.count()} new rows" in caplog.text
    parts[1].write.mode("append").parquet(f"{tables}/documents.parquet")
    caplog.clear()
    both = annotation_notes.run(spark, tables, out)
    assert both.count() == docs.count() and f"read {parts[1].count()} new rows" in caplog.text
    want = rows_of(annotation_notes.screened(docs.drop("n_chars")))
    assert rows_of(both) == want
    caplog.clear()
    assert rows_of(annotation_notes.run(spark, tables, out)) == want and "read 0 new rows" in caplog.text
    sums = spark.read.parquet(f"{out}/by_source").collect()
    assert sum(r["notes"] for r in sums) == docs.count() and sum(r["events"] for r in sums) == sum(r[3] * n for r, n in want.items())
    assert any(f.startswith("lang=") for f in os.listdir(f"{out}/notes"))


def test_an_empty_table_gives_no_notes(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tables}/documents.parquet")
    assert annotation_notes.run(spark, tables, out).collect() == []


# -- command line --------------------------------------------------------------------------


def test_unknown_settings_are_refused():
    assert settings({"a": 1}, {"a": 2}) == {"a": 2}
    with pytest.raises(ValueError, match="b"):
        settings({"a": 1}, {"b": 2})
    for job in (training_set, annotation_notes):
        with open(f"{ROOT}/jobs/{job.__name__.rsplit('.', 1)[-1]}.json") as f:
            assert json.load(f) == job.DEFAULTS


def test_command_line(spark, sf_dir, tmp_path):
    out = str(tmp_path / "notes")
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", "jobs.annotation_notes", "--tables", sf_dir, "--out", out, "--config", f"{ROOT}/jobs/annotation_notes.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert f"read {n} new rows" in done.stderr and spark.read.parquet(f"{out}/notes").count() == n
