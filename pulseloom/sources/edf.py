"""European Data Format files.

:func:`load` reads them through Spark's own file systems, object stores included: a file
is a row of bytes, its header is parsed and its data records are cut into blocks by
expressions, and only the samples of one channel of a block go through numpy. A file's
bytes pass one task, so files are to be below 2 GB.

``spark.read.format("edf")`` is a data source for files of any size, on any file system that
pyarrow opens by its address (local, S3, Google's, HDFS): a partition is a range of records of
one file, so that a long recording is read by many tasks, each of which seeks to its range.
Its options are ``path`` (a folder or a file), ``channel`` (0 by default), ``header_only``,
and ``from_s`` and ``to_s``, a segment of each recording in seconds: whole records that touch
it are read, and no others.

Rows of both are (recording_id, fs, n_samples, duration_s, start_sample, samples), one for
a run of data records; with header_only one for a file, without samples.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "recording_id string, fs double, n_samples bigint, duration_s double, start_sample bigint, samples array<float>"
#: Seconds of signal in one row, about.
BLOCK_S = 60


@dataclass(frozen=True)
class Header:
    header_bytes: int
    records: int
    record_s: float
    per_record: tuple[int, ...]
    physical: tuple[tuple[float, float], ...]
    digital: tuple[tuple[int, int], ...]
    labels: tuple[str, ...]

    def rate(self, channel: int) -> float:
        return self.per_record[channel] / self.record_s

    def scaled(self, raw: np.ndarray, channel: int) -> np.ndarray:
        (pl, ph), (dl, dh) = self.physical[channel], self.digital[channel]
        return ((raw.astype(float) - dl) * (ph - pl) / (dh - dl) + pl).astype(np.float32)


def parse_header(raw: bytes) -> Header:
    """The fixed header of 256 bytes and 256 more for each signal."""
    text = raw[:256].decode("ascii", "replace")
    n = int(text[252:256])
    rest = raw[256 : 256 + 256 * n].decode("latin-1")
    at = 0

    def fields(width: int) -> list[str]:
        nonlocal at
        got = [rest[at + i * width : at + (i + 1) * width].strip() for i in range(n)]
        at += width * n
        return got

    labels, _, _ = fields(16), fields(80), fields(8)
    low, high, dlow, dhigh = fields(8), fields(8), fields(8), fields(8)
    fields(80)
    per = fields(8)
    return Header(
        int(text[184:192]), int(text[236:244]), float(text[244:252]), tuple(map(int, per)),
        tuple((float(a), float(b)) for a, b in zip(low, high, strict=True)), tuple((int(a), int(b)) for a, b in zip(dlow, dhigh, strict=True)), tuple(labels),
    )


def decode(header: Header, records: bytes, channel: int = 0) -> np.ndarray:
    """Samples of one channel from whole data records, in physical units."""
    width = sum(header.per_record)
    start = sum(header.per_record[:channel])
    raw = np.frombuffer(records, "<i2")
    raw = raw[: len(raw) // width * width].reshape(-1, width)[:, start : start + header.per_record[channel]]
    return header.scaled(raw.ravel(), channel)


def files(system: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """A file itself, or all EDF files below a folder, in order."""
    one = system.get_file_info(path)
    if one.type == pafs.FileType.File:
        return [one]
    below = system.get_file_info(pafs.FileSelector(path, recursive=True)) if one.type == pafs.FileType.Directory else []
    return sorted((x for x in below if x.type == pafs.FileType.File and x.path.endswith(".edf")), key=lambda x: x.path)


def head(system: pafs.FileSystem, path: str, size: int) -> Header:
    """The header; a recorder that was cut off leaves the number of records at -1, which the size tells then."""
    with system.open_input_file(path) as f:
        first = f.read(256)
        h = parse_header(first + f.read(256 * int(first[252:256])))
    return h if h.records >= 0 else replace(h, records=(size - h.header_bytes) // (2 * sum(h.per_record)))


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int
    count: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.channel = options["path"], int(options.get("channel", 0))
        self.header_only = str(options.get("header_only", "false")).lower() == "true"
        self.from_s, self.to_s = float(options.get("from_s", 0)), float(options.get("to_s", "inf"))

    def partitions(self) -> list[Range]:
        system, path = pafs.FileSystem.from_uri(self.root)
        found = files(system, path)
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda x: head(system, x.path, x.size), found))
        out = []
        for x, h in zip(found, heads, strict=True):
            if self.header_only:
                out.append(Range(x.path, x.size, 0, h.records))
                continue
            first, end = int(self.from_s // h.record_s), h.records if self.to_s == float("inf") else min(h.records, -int(-self.to_s // h.record_s))
            step = max(1, round(60 * BLOCK_S / h.record_s))
            out += [Range(x.path, x.size, i, min(step, end - i)) for i in range(first, end, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.root)
        h = head(system, part.path, part.size)
        fs, n = h.rate(self.channel), h.records * h.per_record[self.channel]
        facts = (posixpath.basename(part.path)[:-4], fs, n, (n - 1) / fs)
        if self.header_only:
            yield (*facts, 0, [])
            return
        width = 2 * sum(h.per_record)
        step = max(1, round(BLOCK_S / h.record_s))
        with system.open_input_file(part.path) as f:
            f.seek(h.header_bytes + part.first * width)
            for at in range(part.first, part.first + part.count, step):
                k = min(step, part.first + part.count - at)
                yield (*facts, at * h.per_record[self.channel], decode(h, f.read(k * width), self.channel).tolist())


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:  # noqa: ARG002
        return EdfReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(EdfSource)


def load(spark: SparkSession, path: str | list[str], channel: int = 0, header_only: bool = False, name: str = "*.edf") -> DataFrame:
    """The recordings below a folder, or of the given paths, on any file system that Spark reads; ``name`` is a glob of file names."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    text = lambda at, n: F.trim(F.decode(F.substring("content", at, n), "ISO-8859-1"))
    rows = raw.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("recording_id"), "content", F.col("length"),
        text(F.lit(185), F.lit(8)).cast("int").alias("head"), text(F.lit(237), F.lit(8)).cast("int").alias("told"),
        text(F.lit(245), F.lit(8)).cast("double").alias("record_s"), text(F.lit(253), F.lit(4)).cast("int").alias("signals"),
    )

    def each(ahead: int) -> Column:
        """A field of eight characters of every signal; ``ahead``: characters of a signal's fields before it."""
        at = lambda i: text((F.lit(257) + F.col("signals") * ahead + i * 8).cast("int"), F.lit(8))
        return F.transform(F.sequence(F.lit(0), F.col("signals") - 1), at)

    one = lambda ahead: F.get(each(ahead), F.lit(channel)).cast("double")
    rows = rows.withColumns({"per": F.transform(each(216), lambda x: x.cast("int")), "low": one(104), "high": one(112), "dlow": one(120), "dhigh": one(128)})
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    mine = F.get("per", F.lit(channel))
    rows = rows.withColumns({"width": total(F.col("per")) * 2, "mine": mine, "skip": total(F.slice("per", F.lit(1), F.lit(channel)))})
    # A recorder that was cut off leaves the number of records at -1.
    rows = rows.withColumn("records", F.when(F.col("told") >= 0, F.col("told")).otherwise(F.floor((F.col("length") - F.col("head")) / F.col("width"))).cast("int"))
    n = (F.col("records") * F.col("mine")).cast("long")
    fs = F.col("mine") / F.col("record_s")
    facts = ["recording_id", fs.alias("fs"), n.alias("n_samples"), ((n - 1) / fs).alias("duration_s")]
    if header_only:
        return rows.select(*facts, F.lit(0).cast("long").alias("start_sample"), F.array().cast("array<float>").alias("samples"))
    step = F.greatest(F.lit(1), F.round(F.lit(BLOCK_S) / F.col("record_s")).cast("int"))
    first = F.explode(F.when(F.col("records") > 0, F.sequence(F.lit(0), F.col("records") - 1, step))).alias("first")
    blocks = rows.withColumn("step", step).select("*", first)
    bytes_ = F.substring("content", (F.col("head") + F.col("first") * F.col("width") + 1).cast("int"), (F.least("step", F.col("records") - F.col("first")) * F.col("width")).cast("int"))

    @F.pandas_udf("array<float>")
    def samples(raw: pd.Series, width: pd.Series, skip: pd.Series, mine: pd.Series, low: pd.Series, high: pd.Series, dlow: pd.Series, dhigh: pd.Series) -> pd.Series:
        out = []
        for b, w, s, m, pl, ph, dl, dh in zip(raw, width // 2, skip, mine, low, high, dlow, dhigh, strict=True):
            x = np.frombuffer(b, "<i2")
            x = x[: len(x) // w * w].reshape(-1, w)[:, s : s + m].ravel().astype(float)
            out.append(((x - dl) * (ph - pl) / (dh - dl) + pl).astype(np.float32))
        return pd.Series(out)

    start = (F.col("first") * F.col("mine")).cast("long").alias("start_sample")
    return blocks.select(*facts, start, samples(bytes_, "width", "skip", "mine", "low", "high", "dlow", "dhigh").alias("samples"))
