"""Training set of all recordings: features and labels of minutes, 60-minute windows, splits by subject, scaled rows.

    python -m jobs.training_set --tables DIR --out DIR [--config jobs/training_set.json]

Writes below ``out``:
    minutes/shard=*/            features and status of every minute of every recording
    windows/shard=*/            rows of the windows, unscaled
    rows/split=*/shard=*/       the same, scaled by the training split
    scaler/, weights/           mean and deviation of each feature, weight of each class

Every table replaces the one of an earlier run, and all choices (splits, shards) are functions
of the data and the config, so that a rerun, also after a run that broke off, gives the same
result. Tables that later steps read several times are read from what was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings, told
from pulseloom.plans import training
from pulseloom.plans.recordings import _POIN, _STATUS, _TIME_3
from pulseloom.sources.fixtures import BEATS_SQL, SEIZURES_SQL, beats, seizures
from pulseloom.sources.store import shared_folder

#: seed of the splits; shares of subjects for test, and of the rest for validation; folders that
#: recordings are dealt to; digits of scaled features.
DEFAULTS = {"seed": 42, "test": 0.2, "val": 0.2, "shards": 16, "digits": 6}
NAMES = training.TIME_3 + training.POINCARE_5
COLUMNS = ["split", "rec", "window_start_time", "minute", "minute_in_window", "is_padded", *NAMES, *training.BINS, "final_mask"]


def write(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Write a table whose folders ``by`` hold few files each, spread by recording, and read it back."""
    if by:
        df = df.repartition(*by, "rec")
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return told(df.sparkSession.read.schema(df.schema).parquet(path), "wrote", path.rsplit("/", 1)[-1], path)


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> DataFrame:
    """The whole job; gives ``rows`` as written."""
    c, out = settings(DEFAULTS, config), out.rstrip("/")
    # Grid, features and status all look at the beats.
    b = write(told(beats(spark, tables), "read", "beats", tables), f"{out}/beats")
    z = told(seizures(spark, tables), "read", "seizures", tables)
    shard = F.pmod(F.xxhash64("rec"), F.lit(c["shards"])).cast("int").alias("shard")
    minutes = write(training.minute_rows(b, z).select("*", shard), f"{out}/minutes", "shard")
    windows = write(training.window_rows(minutes), f"{out}/windows", "shard")
    order = F.md5(F.concat_ws(":", F.lit(str(c["seed"])), F.col("subject").cast("string")))
    made = training.assembled(windows, NAMES, order, c["test"], c["val"])
    write(made.scaler, f"{out}/scaler")
    write(made.weights, f"{out}/weights")
    rounded = [F.round(n, c["digits"]).alias(n) for n in NAMES]
    rows = made.rows.select(*[x for x in COLUMNS if x not in NAMES], *rounded, "shard")
    rows = write(rows, f"{out}/rows", "split", "shard")
    log.info("done: %s", out)
    return rows.select(COLUMNS)


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all tables, run twice into one new folder; its rows after the second run."""
    out = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    run(spark, sf_dir, out)
    return run(spark, sf_dir, out)


_VALUE = ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n in NAMES)
_HAS = " AND ".join(f"{n} IS NOT NULL" for n in NAMES)
_FIT = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in NAMES)
_SCALED = ", ".join(f"round(({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END, 6) AS {n}" for n in NAMES)
_KEEP = f"rec, minute, {', '.join(NAMES)}, mask, bin_1, bin_2, bin_3, bin_4, training_mask"

SQL = f"""WITH {BEATS_SQL}, {SEIZURES_SQL.format(keys="user_id // 15")}, {_TIME_3}, {_POIN}, {_STATUS},
m AS (SELECT g.rec, g.minute, {_VALUE}, {_HAS} AS mask, bin_1, bin_2, bin_3, bin_4, training_mask
  FROM grid g JOIN status USING (rec, minute) LEFT JOIN time3 t ON t.rec = g.rec AND t.minute = g.minute LEFT JOIN poin p ON p.rec = g.rec AND p.minute = g.minute),
o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY minute) - 1 AS r, count(*) OVER (PARTITION BY rec) AS n, max(greatest(bin_1, bin_2)) OVER (PARTITION BY rec) AS near FROM m),
h AS (SELECT {_KEEP}, r, k FROM (SELECT *, unnest(range(0, (n - 60) // 30 + 1)) AS k FROM o WHERE n >= 60) WHERE r BETWEEN 30 * k AND 30 * k + 59),
win AS (
  SELECT {_KEEP}, min(minute) OVER (PARTITION BY rec, k) * 60.0::DOUBLE AS window_start_time, CAST(r - 30 * k AS INTEGER) AS minute_in_window, false AS is_padded FROM h
  UNION ALL
  SELECT {_KEEP}, min(minute) OVER (PARTITION BY rec) * 60.0::DOUBLE, CAST(j AS INTEGER), j >= n
  FROM (SELECT *, unnest(CASE WHEN r = n - 1 THEN range(r, 60) ELSE [r] END) AS j FROM o WHERE n < 60 AND near > 0)
), sub AS (SELECT rec, row_number() OVER (ORDER BY md5('42:' || rec), rec) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT rec FROM win)),
cnt AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS nt FROM sub),
sp AS (SELECT rec, CASE WHEN k <= nt THEN 'test' WHEN k <= nt + greatest(1, CAST(floor((n - nt) * 0.2) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM cnt),
x AS (SELECT * FROM win JOIN sp USING (rec)), fit AS (SELECT {_FIT} FROM x WHERE split = 'train')
SELECT split, rec, window_start_time, minute, minute_in_window, is_padded, {_SCALED}, bin_1, bin_2, bin_3, bin_4, training_mask = 1 AND mask AND NOT is_padded AS final_mask
FROM x, fit"""

if __name__ == "__main__":
    main("training_set", run)
