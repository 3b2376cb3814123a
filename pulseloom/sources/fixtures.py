"""Beats and seizures derived from the TPC-H-like tables, and other stand-ins for recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, beat_idx, rr_ms, t_ms): about 6000 beats a recording, with short and long artifacts."""
    line = table(spark, sf_dir, "lineitem")
    rr = (
        F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1) & (F.col("l_linenumber") == 1), 150)
        .when((F.col("l_tax") == 0.0) & (F.col("l_discount") == 0.0) & (F.col("l_linenumber") == 7), 2500)
        .otherwise((500 + 20 * F.col("l_quantity")).cast("bigint"))
    )
    rows = line.select(
        F.expr("l_suppkey div 10").alias("rec"), rr.cast("bigint").alias("rr_ms"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    order = Window.partitionBy("rec").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        "rec",
        F.row_number().over(order).cast("bigint").alias("beat_idx"),
        "rr_ms",
        F.sum("rr_ms").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("t_ms"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, idx, onset_s, dur_s, eventType): all annotation events with a value, in file order."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(F.expr("user_id div 15").alias("rec"), *_annotation(F.col("event_id"), F.col("event_type")))


def _annotation(idx: Column, kind: Column) -> list[Column]:
    return [
        idx.alias("idx"), ((idx * 37) % 6000).alias("onset_s"), (20 + idx % 100).alias("dur_s"), F.when(kind == "error", "sz_foc_ia_nm").otherwise("bckg").alias("eventType"),
    ]


def seizures(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """(rec, idx, onset_s, dur_s, eventType): two events of each recording, in file order.

    Of all its events the one with the largest value and the one with the smallest, the
    earlier on ties. ``dense``: two of each recording and event type. (With all of them hardly
    a minute of a recording would be left that isn't near a seizure.)
    """
    e = table(spark, sf_dir, "events").select(F.expr("user_id div 15").alias("rec"), "event_type", "event_id", "value").where("value IS NOT NULL")
    keys = ["rec", "event_type"] if dense else ["rec"]
    top = F.max(F.struct("value", (-F.col("event_id")).alias("id"), "event_type"))
    low = F.min(F.struct("value", F.col("event_id").alias("id"), "event_type"))
    ends = e.groupBy(*keys).agg(F.array(top, low).alias("ends")).select("rec", F.explode("ends").alias("e"))
    return ends.select("rec", *_annotation(F.abs("e.id"), F.col("e.event_type"))).distinct()


#: The same tables as common table expressions for DuckDB.
BEATS_SQL = """raw AS (
  SELECT l_suppkey // 10 AS rec,
    CAST(CASE WHEN l_tax = 0.08 AND l_discount = 0.1 AND l_linenumber = 1 THEN 150
      WHEN l_tax = 0.0 AND l_discount = 0.0 AND l_linenumber = 7 THEN 2500
      ELSE 500 + 20 * l_quantity END AS BIGINT) AS rr_ms,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
), beats AS (
  SELECT rec,
    row_number() OVER (PARTITION BY rec ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS beat_idx,
    rr_ms,
    CAST(sum(rr_ms) OVER (PARTITION BY rec ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS t_ms
  FROM raw
), clean AS (SELECT * FROM beats WHERE rr_ms BETWEEN 200 AND 2000),
grid AS (
  SELECT rec, CAST(unnest(range(0, max(t_ms) // 60000)) AS INTEGER) AS minute FROM beats GROUP BY rec
)"""
EVENTS_SQL = """seizures AS (
  SELECT user_id // 15 AS rec, event_id AS idx, (event_id * 37) % 6000 AS onset_s, 20 + event_id % 100 AS dur_s,
    CASE WHEN event_type = 'error' THEN 'sz_foc_ia_nm' ELSE 'bckg' END AS eventType
  FROM events WHERE value IS NOT NULL
)"""
SEIZURES_SQL = """seizures AS (
  SELECT user_id // 15 AS rec, event_id AS idx, (event_id * 37) % 6000 AS onset_s, 20 + event_id % 100 AS dur_s,
    CASE WHEN event_type = 'error' THEN 'sz_foc_ia_nm' ELSE 'bckg' END AS eventType
  FROM events WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY value DESC, event_id) = 1 OR row_number() OVER (PARTITION BY {keys} ORDER BY value, event_id) = 1
)"""
