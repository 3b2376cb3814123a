"""What the jobs share: config, command line, log, shared folder."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(defaults: dict, given: dict | None = None) -> dict:
    """``defaults`` with what is given; a name that isn't known is an error."""
    unknown = set(given or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (given or {})


def told(df: DataFrame, verb: str, what: str, path: str) -> DataFrame:
    """``df``, after its number of rows is logged."""
    log.info("%s %d rows of %s: %s", verb, df.count(), what, path)
    return df


def main(name: str, run: Callable[[SparkSession, str, str, dict], object]) -> None:
    """Run a job from the command line, in a session of its own."""
    args = argparse.ArgumentParser(prog=name)
    args.add_argument("--tables", required=True, help="folder of the input tables; any path that Spark can read")
    args.add_argument("--out", required=True, help="folder of the output; any path that Spark can write")
    args.add_argument("--config", help="JSON file with settings")
    got = args.parse_args()
    config = {}
    if got.config:
        with open(got.config) as f:
            config = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, got.tables, got.out, config)
    finally:
        spark.stop()
