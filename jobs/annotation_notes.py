"""Screening of written notes for seizures, as they arrive.

    python -m jobs.annotation_notes --tables DIR --out DIR [--config jobs/annotation_notes.json]

Annotators leave free text beside the files of events. Each line of a note is judged as an
event type is: a numeric code, or one of the words that mark a seizure. The job is a stream
over the files of ``documents`` that ends once it has read all there are; its checkpoint names
the files that were read, and a run takes only those that are new. Writes below ``out``:

    notes/lang=*/        a row for each note, also for those without a seizure
    by_source/           notes, lines and lines with a seizure of each source, over all runs
    checkpoint/          of the stream

The file sink adds a batch as a whole or not at all, so that a run that broke off is taken up
by the next without loss or repeats; ``by_source`` is formed anew from all notes. Rows are
judged one by one: no state is kept, and nothing is shuffled ahead of the sink.

Null texts have no lines; very long ones are read whole; notes that repeat are kept as often as
they come, and a null or empty language is read back as null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings, told
from pulseloom.functions.columns import SEIZURE_CODES, SEIZURE_WORDS, is_seizure
from pulseloom.sources.store import shared_folder

#: Files of one batch; age beyond which a file that arrives late would be left out.
DEFAULTS = {"max_files": 1000, "max_age": "3650d"}
NOTES = "doc_id long, source string, n_lines long, n_events long, first_event int, words string, codes string, lang string"


def screened(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_lines, n_events, first_event, words, codes, lang) of each note.

    n_lines: lines that aren't blank; n_events: those that mean a seizure; first_event: the
    number of the first of these among all lines, from 1, or null; words, codes: what marks a
    seizure anywhere in the text, in order of the lists, joined by commas.
    """
    text = F.coalesce("text", F.lit(""))
    listed = lambda values, holds: F.array_join(F.filter(F.array(*map(F.lit, values)), holds), ",")
    rows = docs.select("doc_id", "source", "lang", F.lower(text).alias("_low"), F.split(text, "\n").alias("_lines"), F.split(text, r"[\x20\x09-\x0D]+").alias("_words"))
    events = lambda lines: F.transform(lines, is_seizure)
    rows = rows.withColumn("_hits", events("_lines"))
    first = F.array_position("_hits", F.lit(True)).cast("int")
    count = lambda array, holds: F.size(F.filter(array, holds)).cast("long")

    def filled(line: Column) -> Column:
        return line.rlike(r"[^\x20\x09-\x0D]")

    return rows.select(
        "doc_id", "source", count("_lines", filled).alias("n_lines"), count("_hits", lambda h: h).alias("n_events"), F.when(first > 0, first).alias("first_event"),
        listed(SEIZURE_WORDS, lambda w: F.contains("_low", w)).alias("words"), listed(SEIZURE_CODES, lambda c: F.array_contains("_words", c)).alias("codes"), "lang",
    )


def by_source(notes: DataFrame) -> DataFrame:
    """(source, notes, notes_with_events, lines, events)."""
    return notes.groupBy("source").agg(
        F.count("*").alias("notes"), F.count_if(F.col("n_events") > 0).alias("notes_with_events"), F.sum("n_lines").alias("lines"), F.sum("n_events").alias("events")
    )


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """Read what is new, add it to the notes, and sum up; gives all notes as written."""
    c, out = settings(DEFAULTS, config), out.rstrip("/")
    path = f"{tables.rstrip('/')}/documents.parque[t]"  # a pattern, as a stream takes a single file by pattern only; a folder of files fits too
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["max_files"]).option("maxFileAge", c["max_age"]).parquet(path)
    stream = (
        screened(docs).writeStream.format("parquet").option("path", f"{out}/notes").option("checkpointLocation", f"{out}/checkpoint")
        .partitionBy("lang").outputMode("append").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    new = sum(p["numInputRows"] for p in stream.recentProgress)
    log.info("read %d new rows of documents: %s", new, path)
    notes = told(spark.read.schema(NOTES).parquet(f"{out}/notes"), "hold", "notes", f"{out}/notes")
    by_source(notes).write.mode("overwrite").parquet(f"{out}/by_source")
    told(spark.read.parquet(f"{out}/by_source"), "wrote", "by_source", f"{out}/by_source")
    return notes


def job2_annotation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all documents, run twice into one new folder and checkpoint; its notes after the second run."""
    out = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    run(spark, sf_dir, out)
    return run(spark, sf_dir, out)


SQL = rf"""
WITH d AS (SELECT doc_id, source, lang, lower(coalesce(text, '')) AS low, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT doc_id, source, lang, low, string_split(t, chr(10)) AS lines, string_split_regex(t, '[\x20\x09-\x0D]+') AS words FROM d
), h AS (
  SELECT *, list_transform(lines, lambda x: list_contains({list(SEIZURE_CODES)}, lower(trim(x))) OR regexp_matches(lower(trim(x)), '{"|".join(SEIZURE_WORDS)}')) AS hits FROM l
)
SELECT doc_id, source, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines, CAST(len(list_filter(hits, lambda x: x)) AS BIGINT) AS n_events,
  CAST(nullif(coalesce(list_position(hits, true), 0), 0) AS INTEGER) AS first_event,
  array_to_string(list_filter({SEIZURE_WORDS}, lambda w: contains(low, w)), ',') AS words,
  array_to_string(list_filter({list(SEIZURE_CODES)}, lambda c: list_contains(words, c)), ',') AS codes, nullif(lang, '') AS lang
FROM h"""

if __name__ == "__main__":
    main("annotation_notes", run)
