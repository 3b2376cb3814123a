"""Shards with size-tiered compaction and versioned manifests, in DataFrame operations only.

A store is a folder. Arrivals are appended as small immutable shards, each one a file of
the task that wrote it; where tasks are so large that their files would count as finished,
these are cut, so that compaction acts on arrivals at every size. Compaction groups shards into tiers by their size; a tier with
enough shards is a run of similarly sized ones, cut into groups of about ``target`` bytes,
and each group is written as one shard. A manifest lists the shards of one version. It is
written aside and then renamed to its number, which fails if that number exists: commits
are atomic on file systems whose rename never replaces a file, as HDFS has it (on a store
where it does, writers must take turns). A writer that loses the race reads the new version
and commits on top of it. Files of failed jobs are never listed. ``vacuum`` removes files
that no kept version lists, but none that is younger than its grace: a writer that has
not committed yet keeps its files, and readers of the last versions are not disturbed.

A merged shard is written row by row from the exchange that deals its group to one task:
nothing is sorted, and row groups of ROW_GROUP bytes bound what a task holds, whatever the
size of the group.

Shard sizes are listed through the cluster's file system. Only this metadata, a row for a
file, is handled in the driver; documents never are.

Defined results: any rows are kept as they are, nulls, repeated rows and very long texts too; an
empty table gives a version without shards. Names that begin with two underscores are taken:
inputs are to have no column __shard_file, __shard_group, __tier or __bytes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import shared_dir, table

#: Bytes of a finished shard.
TARGET = 32 << 20
#: Sizes of neighbouring tiers differ by this factor; as many shards make a run.
FACTOR, RUN = 4, 4
#: Bytes of a row group: what a writer holds before it writes.
ROW_GROUP = 8 << 20
#: Commits that a writer tries before it gives up.
TRIES = 20
#: Versions that ``vacuum`` keeps, and the age in seconds below which it spares any file.
KEEP, GRACE = 2, 24 * 3600

_FILE, _GROUP = "__shard_file", "__shard_group"


def shard_of_row() -> Column:
    """A row's shard by the last two parts of its path; Spark never writes two files of one such name."""
    return F.substring_index("_metadata.file_path", "/", -2)


def short(file: str) -> str:
    """A file's name as :func:`shard_of_row` has it."""
    return "/".join(file.split("/")[-2:])


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """A folder of immutable shards and numbered manifests."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET) -> None:
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/_manifests"))

    # -- manifests ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.path}/_manifests"))
        names = [x.getPath().getName() for x in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last: version, schema, shards (file, bytes, tier)."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "schema": None, "shards": []}
            version = known[-1]
        source = self._fs.open(self._path(f"{self.path}/_manifests/v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return json.loads(text)

    def change(self, edit: Callable[[dict], list[dict] | None], schema: str | None = None) -> int:
        """Commit what ``edit`` makes of the last manifest's shards, on a newer one if another writer was first; None commits nothing."""
        for _ in range(TRIES):
            now = self.manifest()
            if (shards := edit(now)) is None:
                return now["version"]
            try:
                return self.commit(now["version"], shards, schema or now["schema"])
            except ConflictError:
                continue
        raise ConflictError(f"no commit in {TRIES} tries")

    def commit(self, base: int, shards: list[dict], schema: str) -> int:
        """Publish the shards as version base + 1, or fail whole."""
        version = base + 1
        aside = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        out.close()
        final = self._path(f"{self.path}/_manifests/v{version:08d}.json")
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise ConflictError(f"version {version} exists")
        return version

    # -- shards ------------------------------------------------------------------------

    def _files(self, folder: str, latest: float | None = None) -> list[dict]:
        """Shards below a folder that a finished job has written, by ``latest`` (milliseconds) if given."""
        found, walk = [], self._fs.listFiles(self._path(f"{self.path}/{folder}"), True)
        while walk.hasNext():
            x = walk.next()
            name = x.getPath().toString()
            if name.endswith(".parquet") and x.getLen() and "/_temporary/" not in name and (latest is None or x.getModificationTime() <= latest):
                found.append({"file": name[name.index(f"/{folder}/") + 1 :], "bytes": x.getLen()})
        return sorted(found, key=lambda x: x["file"])

    def tier(self, size: int) -> int:
        """0 for finished shards; each further tier is FACTOR times smaller."""
        tier, least = 0, self.target // 2
        while size < least:
            tier, least = tier + 1, least // FACTOR
        return tier

    def append(self, docs: DataFrame) -> int:
        """Add rows as small shards, one for each task that holds rows, or several where that one would count as finished."""
        schema, folder = docs.schema.json(), f"arrivals-{uuid.uuid4().hex}"
        self._write(docs, folder)
        new = self._files(folder)
        # Again where rows are of very different sizes, until only shards of a single row are left.
        while large := [x for x in new if self.tier(x["bytes"]) == 0]:
            cut = self._cut(large, schema)
            if len(cut) <= len(large):
                self._remove(cut)
                break
            new = [x for x in new if x not in large] + cut
            self._remove(large)
        new = [x | {"tier": self.tier(x["bytes"])} for x in new]
        return self.change(lambda now: now["shards"] + new, schema)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{folder}")

    def _replace(self, old: list[dict], new: list[dict]) -> int:
        """Commit ``new`` in place of ``old``; where another writer has replaced one of these already, ``new`` is removed."""
        gone = {x["file"] for x in old}
        new = [x | {"tier": self.tier(x["bytes"])} for x in new]

        def edit(now: dict) -> list[dict] | None:
            rest = [x for x in now["shards"] if x["file"] not in gone]
            return rest + new if len(now["shards"]) - len(rest) == len(gone) else None

        version = self.change(edit)
        if new and new[0]["file"] not in {x["file"] for x in self.manifest(version)["shards"]}:
            self._remove(new)
        return version

    def _remove(self, files: list[dict]) -> None:
        """Remove files that no manifest lists."""
        for x in files:
            self._fs.delete(self._path(f"{self.path}/{x['file']}"), False)

    def _cut(self, large: list[dict], schema: str) -> list[dict]:
        """The rows of shards again, dealt to shards of about a FACTORth of the target."""
        folder, place, n = f"cut-{uuid.uuid4().hex}", [], 0
        for x in large:
            k = -(-x["bytes"] * FACTOR // self.target)
            place.append((short(x["file"]), n, k))
            n += k
        plan = F.broadcast(self.spark.createDataFrame(place, f"{_FILE} string, {_GROUP} int, __shard_cuts int"))
        rows = self.read_files([x["file"] for x in large], schema).withColumn(_FILE, shard_of_row()).join(plan, _FILE)
        piece = (F.col(_GROUP) + F.monotonically_increasing_id() % F.col("__shard_cuts")).cast("int")
        rows = rows.withColumn(_GROUP, piece).drop(_FILE, "__shard_cuts").repartitionById(n, _GROUP).drop(_GROUP)
        self._write(rows, folder)
        return self._files(folder)

    def groups(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized shards that are due to be merged."""
        by_tier: dict[int, list[dict]] = {}
        for x in shards:
            by_tier.setdefault(x["tier"], []).append(x)
        due = []
        for tier in sorted(by_tier, reverse=True):
            run = sorted(by_tier[tier], key=lambda x: (x["bytes"], x["file"])) if tier else []
            if len(run) < RUN:
                continue
            group, size = [], 0
            for x in run:
                if group and size + x["bytes"] > self.target * 5 // 4:
                    due.append(group)
                    group, size = [], 0
                group.append(x)
                size += x["bytes"]
            due.append(group)
        return [g for g in due if len(g) > 1]

    def compact(self) -> int:
        """Merge all due groups in one job and commit; the same version if none is due. Shards of twice the target or more are cut first."""
        now = self.manifest()
        if large := [x for x in now["shards"] if x["bytes"] >= 2 * self.target]:
            cut = self._cut(large, now["schema"])
            if len(cut) > len(large):
                self._replace(large, cut)
                now = self.manifest()
            else:
                self._remove(cut)
        due = self.groups(now["shards"])
        if not due:
            return now["version"]
        folder = f"merged-{uuid.uuid4().hex}"
        place = [(short(x["file"]), i) for i, g in enumerate(due) for x in g]
        # A row for each merged file: metadata of one compaction, far smaller than a shard.
        plan = F.broadcast(self.spark.createDataFrame(place, f"{_FILE} string, {_GROUP} int"))
        rows = self.read_files([x["file"] for g in due for x in g], now["schema"])
        rows = rows.withColumn(_FILE, shard_of_row()).join(plan, _FILE).drop(_FILE)
        # One task for each group, and one file from each task.
        self._write(rows.repartitionById(len(due), _GROUP).drop(_GROUP), folder)
        return self._replace([x for g in due for x in g], self._files(folder))

    def read_files(self, files: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        as_read = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], as_read)
        return self.spark.read.schema(as_read).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        at = self.manifest(version)
        return self.read_files([x["file"] for x in at["shards"]], at["schema"])

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> None:
        """Remove manifests but the last ``keep``, then files older than ``grace`` seconds that none of those lists."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifests/v{v:08d}.json"), False)
        listed = {x["file"] for v in known[-keep:] for x in self.manifest(v)["shards"]}
        latest = (time.time() - grace) * 1000
        for x in self._fs.listStatus(self._path(self.path)):
            folder = x.getPath().getName()
            if not folder.startswith("_"):
                self._remove([f for f in self._files(folder, latest) if f["file"] not in listed])

    def placed(self, version: int | None = None, column: str = "placed") -> DataFrame:
        """The rows of a version with struct ``column``: shard, tier, bytes of the shard, version."""
        at = self.manifest(version)
        known = [(short(x["file"]), x["tier"], x["bytes"]) for x in at["shards"]]
        shards = F.broadcast(self.spark.createDataFrame(known, f"{_FILE} string, __tier int, __bytes long"))
        rows = self.read_files([x["file"] for x in at["shards"]], at["schema"])
        rows = rows.withColumn(_FILE, shard_of_row() if at["shards"] else F.lit(None).cast("string")).join(shards, _FILE)
        place = F.struct(
            F.col(_FILE).alias("shard"), F.col("__tier").alias("tier"), F.col("__bytes").alias("shard_bytes"),
            F.lit(at["version"]).alias("version"),
        )
        return rows.withColumn(column, place).drop(_FILE, "__tier", "__bytes")


def sharded(docs: DataFrame, path: str | None = None, target: int = TARGET) -> Store:
    """Append ``docs`` to a store, compact it, and drop what was merged.

    Without a path it is a new store in the shared folder, which has no other writer or
    reader yet: there, what was merged goes at once.
    """
    spark = docs.sparkSession
    store = Store(spark, path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target)
    store.append(docs)
    before = -1
    while before != (before := store.compact()):
        pass
    store.vacuum() if path else store.vacuum(1, 0)
    return store


def op1_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard the documents; a row for each of them with its place in the last version."""
    store = sharded(table(spark, sf_dir, "documents"))
    return store.placed().select("doc_id", "placed.*")
