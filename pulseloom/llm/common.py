"""What the training-data operators share: reading, staging and word rules."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of ``sf_dir``; only the named columns are read, when any are named."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session names one, or the context's checkpoint
    folder. A local session without either (a test) gets a temporary folder, set once so
    that later calls agree; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pulseloom-"))
            held = context._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`staged` that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._staged_at)


def words(text: str | Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """The number of words; null and blank texts have none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While this holds, Arrow batches have at most n rows: for rows that are blocks of many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)
