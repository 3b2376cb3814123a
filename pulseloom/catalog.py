"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseloom.plans import analysis, recordings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return recordings.QUERIES | analysis.QUERIES


def oracle_sql() -> dict[str, str]:
    return recordings.SQL | analysis.SQL
