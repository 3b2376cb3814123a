"""The jobs as queries, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import annotation_notes, training_set


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_training_set": training_set.job1_training_set, "job2_annotation_notes": annotation_notes.job2_annotation_notes}


def oracle_sql() -> dict[str, str]:
    return {"job1_training_set": training_set.SQL, "job2_annotation_notes": annotation_notes.SQL}
