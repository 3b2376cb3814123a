"""Files: trees, annotations, EDF, sinks; and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulseloom.sources import edf, files
from pulseloom.streaming import minutes


def write_edf(path, channels, fs, record_s=1.0):
    n, records = len(channels), len(channels[0]) // int(fs * record_s)
    pad = lambda x, w: str(x).ljust(w).encode()
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(record_s, 8) + pad(n, 4)
    per = int(fs * record_s)
    for value, width in (("ch", 16), ("", 80), ("mV", 8), (-5, 8), (5, 8), (-32768, 8), (32767, 8), ("", 80), (per, 8), ("", 32)):
        head += pad(value, width) * n
    raw = [np.round((np.asarray(c) + 5) / 10 * 65535 - 32768).astype("<i2") for c in channels]
    with open(path, "wb") as f:
        f.write(head)
        for r in range(records):
            for c in raw:
                f.write(c[r * per : (r + 1) * per].tobytes())


def test_edf_round_trip(spark, tmp_path):
    x, y = np.sin(np.arange(256 * 150) / 30), np.cos(np.arange(256 * 150) / 30)
    write_edf(tmp_path / "sub-1_run-01_ecg.edf", [x, y], 256)
    edf.register(spark)
    for channel, want in ((0, x), (1, y)):
        rows = spark.read.format("edf").option("path", str(tmp_path)).option("channel", channel).load().orderBy("start_sample").collect()
        got = np.concatenate([r["samples"] for r in rows])
        assert len(rows) == 3 and np.abs(got - want).max() < 1e-3 and rows[0]["fs"] == 256.0
    # By address, a segment of whole records, and a recording that was cut off.
    part = spark.read.format("edf").option("path", f"file://{tmp_path}/sub-1_run-01_ecg.edf").option("from_s", 61.5).option("to_s", 64).load().collect()
    got = np.concatenate([r["samples"] for r in sorted(part, key=lambda r: r["start_sample"])])
    assert part[0]["start_sample"] == 61 * 256 and np.allclose(got, x[61 * 256 : 64 * 256], atol=1e-3)
    (tmp_path / "cut").mkdir()
    raw = bytearray((tmp_path / "sub-1_run-01_ecg.edf").read_bytes())
    raw[236:244] = b"-1      "
    (tmp_path / "cut" / "sub-2_run-01_ecg.edf").write_bytes(raw[: len(raw) - 2 * 2 * 256])
    short = spark.read.format("edf").option("path", str(tmp_path / "cut")).option("header_only", "true").load().first()
    assert short["recording_id"] == "sub-2_run-01_ecg" and short["n_samples"] == len(x) - 256
    (tmp_path / "cut" / "sub-2_run-01_ecg.edf").unlink()
    assert spark.read.format("edf").option("path", str(tmp_path / "cut")).load().collect() == []
    head = spark.read.format("edf").option("path", str(tmp_path)).option("header_only", "true").load().collect()
    assert len(head) == 1 and abs(head[0]["duration_s"] - (256 * 150 - 1) / 256) < 1e-9 and head[0]["samples"] == []


def test_edf_by_spark_equals_the_data_source(spark, tmp_path):
    x, y = np.sin(np.arange(200 * 150) / 30), np.cos(np.arange(200 * 150) / 30)
    write_edf(tmp_path / "sub-1_run-01_ecg.edf", [x, y], 200)
    write_edf(tmp_path / "sub-1_run-02_ecg.edf", [x[:2000]], 200)
    cut = bytearray((tmp_path / "sub-1_run-02_ecg.edf").read_bytes())
    cut[236:244] = b"-1      "  # a recorder that didn't finish
    (tmp_path / "sub-1_run-02_ecg.edf").write_bytes(cut)
    for channel, want in ((0, x), (1, y)):
        rows = edf.load(spark, str(tmp_path), channel).where("recording_id = 'sub-1_run-01_ecg'").orderBy("start_sample").collect()
        got = np.concatenate([r["samples"] for r in rows])
        assert [r["start_sample"] for r in rows] == [0, 12_000, 24_000] and np.abs(got - want).max() < 1e-3
    head = {r["recording_id"]: r for r in edf.load(spark, str(tmp_path), header_only=True).collect()}
    assert head["sub-1_run-01_ecg"]["fs"] == 200 and head["sub-1_run-02_ecg"]["n_samples"] == 2000 and head["sub-1_run-02_ecg"]["samples"] == []


def test_from_files_to_windows(spark, tmp_path):
    """Spikes at known times in EDF files, through the whole plan, against the operators on those times."""
    from pulseloom.operators import signal
    from pulseloom.plans.files import window_rows

    rng = np.random.default_rng(2)
    beats = {}

    def write(subject, run, seconds, tsv):
        base = tmp_path / f"sub-{subject}" / "ses-01"
        for d in ("eeg", "ecg"):
            (base / d).mkdir(parents=True, exist_ok=True)
        name = f"sub-{subject}_ses-01_task-x_run-{run}"
        at = np.cumsum(rng.integers(150, 300, int(seconds * 256 / 150)))
        at = at[at < seconds * 256 - 300]
        x = 0.01 * rng.normal(size=seconds * 256)
        for k, v in enumerate((0.1, 0.5, 1.0, 0.5, 0.1)):
            x[at + k - 2] += v
        write_edf(base / "ecg" / f"{name}_ecg.edf", [x], 256)
        write_edf(base / "eeg" / f"{name}_eeg.edf", [np.zeros(seconds * 10)], 10)
        if tsv:
            (base / "eeg" / f"{name}_events.tsv").write_text("onset\tduration\teventType\n" + tsv)
        beats[f"{name}_ecg"] = at

    write("001", "01", 4000, "3700\t30\tsz_foc_ia_nm\n100\t5\tbckg\n")
    write("001", "02", 1200, "600\t30\t1.5\n")  # short, with a seizure: padded
    write("002", "01", 1200, "")  # short, without: dropped
    rows = window_rows(spark, str(tmp_path)).collect()
    assert {(r["subject_id"], r["recording_id"][-10:]) for r in rows} == {("sub-001", "run-01_ecg"), ("sub-001", "run-02_ecg")} and len(rows) == 120
    long = sorted((r for r in rows if "run-01" in r["recording_id"]), key=lambda r: r["minute_in_window"])
    assert [r["minute_in_window"] for r in long] == list(range(60)) and not any(r["is_padded"] for r in long)
    at = beats["sub-001_ses-01_task-x_run-01_ecg"]
    rr = np.diff(at) / 256 * 1000
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(rr, at[1:] / 256 * 1000, strict=True))], "rec long, beat_idx long, rr_ms double, t_ms double")
    want = {r["minute"]: r for r in signal.minute_features(df).collect()}
    for r in long:
        m = int(r["minute_time"] // 60)
        for c in ("RRMean_3", "SDNN_3", "SampEn_3", "ApEn_5", "SD1_5", "LF_POWER_10", "HF_NORM_10"):
            assert abs((want[m][c] or 0.0) - r[c]) <= 1e-6 * max(1, abs(r[c])), (m, c)
        assert r["mask"] == int(m >= 10) and r["bin_4"] == int(abs(3700 - 60 * m) >= 3600) and r["bin_1"] == int(abs(3700 - 60 * m) < 300)
    short = [r for r in rows if "run-02" in r["recording_id"]]
    # The last sample lies below 1200 s, so that 19 minutes are full.
    assert sum(r["is_padded"] for r in short) == 41 and max(r["minute_time"] for r in short) == 18 * 60.0


def test_tree_runs_and_annotations(spark, tmp_path):
    base = tmp_path / "sub-001" / "ses-01"
    (base / "eeg").mkdir(parents=True)
    (base / "ecg").mkdir()
    for n in ("sub-001_ses-01_task_run-01_eeg.edf", "sub-001_ses-01_task_run-02_eeg.edf"):
        (base / "eeg" / n).write_bytes(b"x")
    (base / "ecg" / "sub-001_ses-01_task_run-01_ecg.edf").write_bytes(b"x")
    (base / "ecg" / "sub-001_ses-01_task_ecg.edf").write_bytes(b"x")
    (base / "eeg" / "sub-001_ses-01_task_run-01_events.tsv").write_text("onset\tduration\teventType\n10\t5\tsz_foc_ia_nm\n20\tn/a\tbckg\n")
    (base / "eeg" / "sub-001_ses-01_task_run-02_events.tsv").write_text("eventType\tonset\n3.6\t7.5\n")
    found = files.categorised(files.listed(spark, str(tmp_path)))
    runs = {r["run"]: r for r in files.matched(found).collect()}
    assert set(runs) == {"01", "02"} and runs["02"]["ecg_file"] is None
    assert files.complete(files.matched(found)).count() == 1
    e = {r["onset"]: r for r in files.annotations(spark, str(base / "eeg" / "*_events.tsv")).collect()}
    assert e[10.0]["is_sz"] and not e[20.0]["is_sz"] and e[20.0]["duration"] is None and e[7.5]["duration"] == 60.0 and e[7.5]["is_sz"]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "sub-1", 0.0, 1, 1, 0, 0, 0, 0.5)], "subject_id string, recording_id string, minute_time double, training_mask int, bin_1 int, bin_2 int, bin_3 int, bin_4 int, RRMean_3 double")
    files.write_features(rows, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "sub-1_features.csv").write_text("minute_time,training_mask,bin_1,bin_2,bin_3,bin_4\n60.0,1,0,0,0,1\n0.0,1,0,0,0,1\n")
    (tmp_path / "csv" / "combined_features.csv").write_text("minute_time,training_mask,bin_1,bin_2,bin_3,bin_4\n60.0,1,0,0,0,1\n")
    assert [r[0] for r in files.read_features(spark, str(tmp_path / "csv")).select("minute_time").collect()] == [0.0, 60.0]
    for name, write in (("t", files.write_table), ("j", files.write_json)):
        write(rows, str(tmp_path / name))
    files.write_text(rows.select(F.col("subject_id").alias("value")), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first()[0] == "1"
    seq = spark.createDataFrame([([1.0, 2.0], "train")], "ts array<double>, split string")
    files.write_splits(seq, str(tmp_path / "s"))
    assert files.read_sequences(spark, str(tmp_path / "s")).first()["final_mask"] == [True, True]
    w = spark.createDataFrame([(0, 2.0), (2, 0.5)], "cls int, weight double")
    assert {r["cls"]: r["weight"] for r in files.decode_weights(files.encode_weights(w)).collect()} == {0: 2.0, 1: 1.0, 2: 0.5, 3: 1.0}


def test_streamed_minutes_equal_the_batch(spark, sf_dir, tmp_path):
    """Beats out of order within the lateness; what is left at the end comes by the timeout."""
    from pulseloom.operators import features
    from pulseloom.sources.fixtures import beats

    b = beats(spark, sf_dir).where("t_ms <= 1200000").select("rec", "beat_idx", "t_ms", "rr_ms")
    rows = sorted(b.collect(), key=lambda r: (r["t_ms"] // 90_000, hash((r["beat_idx"] * 7919) % 1009)))  # shuffled within 90 seconds
    late = [(999, 10_000_000_000 + i, 800) for i in range(2)]  # another recording, much later: it moves the watermark
    parts = [rows[:400], rows[400:900], rows[900:]]
    schema = "rec long, ts timestamp_ltz, rr_ms long"
    for i, part in enumerate([*([(r["rec"], r["t_ms"], r["rr_ms"]) for r in p] for p in parts), late, late]):
        df = spark.createDataFrame(part, "rec long, t long, rr_ms long").selectExpr("rec", "timestamp_millis(t) AS ts", "rr_ms")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = minutes.trailing_features(stream).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["rec"], r["minute"]): r for r in spark.sql("SELECT * FROM streamed WHERE rec < 999").collect()}
    want = {(r["rec"], r["minute"]): r for r in features.time_domain(b).collect()}
    assert set(want) <= set(got) and len(want) > 10
    for k, r in want.items():
        assert got[k]["n"] == r["n"] and all(abs(got[k][c] - float(r[c])) < 1e-5 for c in ("RRMean_3", "RRMin_3", "RRVar_3", "RMSSD_3", "SDSD_3", "NN50_3", "pNN50_3"))


def test_streamed_windows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "e"))
    for make in (minutes.hopping, minutes.sessions):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName(make.__name__).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"SELECT * FROM {make.__name__}").count() > 0
