"""Trees of recordings, annotations and feature tables; and how results are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.columns import is_seizure, run_number
from pulseloom.schemas import require_columns


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path): every file of a tree, local or in an object store; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def categorised(paths: DataFrame) -> DataFrame:
    """(subject, session, modality, path) of files that lie in sub-*/ses-*/eeg or ecg and have a known ending."""
    part = r"/(sub-[^/]+)/(ses-[^/]+)/(eeg|ecg)/[^/]+$"
    rows = paths.select(*[F.regexp_extract("path", part, i).alias(n) for i, n in ((1, "subject"), (2, "session"), (3, "folder"))], "path")
    kind = (
        F.when((F.col("folder") == "eeg") & F.col("path").endswith("_eeg.edf"), "eeg")
        .when((F.col("folder") == "eeg") & F.col("path").endswith("_events.tsv"), "events")
        .when((F.col("folder") == "ecg") & F.col("path").endswith("_ecg.edf"), "ecg")
    )
    return rows.select("subject", "session", kind.alias("modality"), "path").where("modality is not null")


def matched(found: DataFrame) -> DataFrame:
    """(subject, session, run, eeg_file, ecg_file, annotation_file): a full outer match as one pivot; the last path wins."""
    rows = found.withColumn("run", run_number("path")).where("run is not null")
    one = lambda m: F.max(F.when(F.col("modality") == m, F.col("path")))
    return rows.groupBy("subject", "session", "run").agg(one("eeg").alias("eeg_file"), one("ecg").alias("ecg_file"), one("events").alias("annotation_file"))


def complete(runs: DataFrame) -> DataFrame:
    """Runs with both signals."""
    return runs.where("eeg_file is not null and ecg_file is not null")


def annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(recording_id, onset, duration, eventType, is_sz) of tab-separated files; a file without eventType gives nothing."""
    return _tsv(spark, paths).withColumn("is_sz", is_seizure("eventType")).where("eventType is not null")


def _tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Columns by the header of each file, whatever their order."""
    lines = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = lines.select("path", F.split("value", "\r?\n").alias("line"))
    rows = rows.select("path", F.split(F.get("line", F.lit(0)), "\t").alias("head"), F.posexplode(F.slice("line", 2, 1 << 30)).alias("idx", "row")).where("row != ''")
    rows = rows.withColumn("cell", F.split("row", "\t"))
    cell = lambda n: F.get("cell", F.array_position("head", n).cast("int") - 1)
    name = F.regexp_extract("path", r"([^/]+)_events\.tsv$", 1)
    has = F.array_contains("head", "duration")
    return rows.select(
        name.alias("recording_id"), "idx", cell("onset").try_cast("double").alias("onset"),
        F.when(has, cell("duration").try_cast("double")).otherwise(60.0).alias("duration"), cell("eventType").alias("eventType"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of per-run files, checked and in order of time; a combined file beside them is not read twice."""
    rows = spark.read.option("header", "true").option("inferSchema", "true").option("pathGlobFilter", "sub-*_features.csv").option("recursiveFileLookup", "true").csv(path)
    return require_columns(rows, ["minute_time", "training_mask", *[f"bin_{i}" for i in range(1, 5)]]).orderBy("minute_time")


def write_features(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature rows by subject and recording; 'csv' for exchange."""
    rows.write.mode("overwrite").partitionBy("subject_id", "recording_id").option("header", "true").format(fmt).save(path)


def write_table(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A summary, report or comparison as csv, json or parquet."""
    rows.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def write_json(row: DataFrame, path: str) -> None:
    """Metadata as JSON lines."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_text(rows: DataFrame, path: str) -> None:
    """Report lines from column ``value``."""
    rows.select("value").write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Sequences by split, compressed."""
    rows.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of any version: without final_mask the older train_mask counts, else all rows."""
    rows = spark.read.parquet(path)
    if "final_mask" in rows.columns:
        return rows
    if "train_mask" in rows.columns:
        return rows.withColumnRenamed("train_mask", "final_mask")
    return rows.withColumn("final_mask", F.transform("ts", lambda _: F.lit(True)))


def encode_weights(weights: DataFrame) -> DataFrame:
    """(json) of (cls, weight)."""
    return weights.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "weight"))))).alias("json"))


def decode_weights(encoded: DataFrame, classes: int = 4) -> DataFrame:
    """(cls, weight); classes that are missing weigh 1."""
    m = F.from_json("json", "map<string,double>")
    spine = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls")
    return encoded.select(m.alias("m"), spine).select("cls", F.coalesce(F.try_element_at("m", F.col("cls").cast("string")), F.lit(1.0)).alias("weight"))
