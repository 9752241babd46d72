"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable shards, one Parquet file each. Compaction takes runs of similar size (a tier is
a power of ``fanout`` times ``MIN_BYTES``) and merges at least ``fanout`` of them into files of up to the target size; a
file from ``SEALED`` of the target on is left as it is. A version is one JSON file that names its shards; it is written
under another name and renamed, which fails if that version is there, so a reader sees a whole version or none and of
two writers one starts again. Shards of older versions, and of writers that never committed, stay until ``vacuum`` finds
them older than its grace time. The rename must fail where its target exists, as HDFS and local file systems do through
Hadoop's layer; on object stores, whose rename copies, let one writer commit at a time.

Planning works on the manifest (a line a shard, on the driver: a table of 100 TB has 100,000 lines of 1 GB each, so its
target is to be of that size); rows move once, by the merge's own number, a task each, so a task holds one
target file. All files go through Spark's file system layer, so the store can be any that Spark reaches.

Edge cases: an empty arrival adds a version without shards; null and repeated rows are rows like others; columns of any
name are kept as they are (the merge's own columns take names that no column has); an arrival with other columns than the store's raises ValueError.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, FANOUT, MIN_BYTES, SEALED = 32 << 20, 4, 64 << 10, 0.6
ROWS_PER_ARRIVAL = 1000
GRACE_S = 24 * 3600.0  # data files younger than this may belong to a writer that has yet to commit
BROADCAST_FILES = 200_000  # names of some 100 bytes; longer lists are joined by a shuffle


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    bytes: int
    added: int  # the version that added it


def free(name: str, columns: list[str]) -> str:
    """The name, or with as many _ as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def tier(size: int, fanout: int = FANOUT) -> int:
    return max(0, math.floor(math.log(max(size, 1) / MIN_BYTES, fanout) + 1e-9)) if size > MIN_BYTES else 0


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT, force: bool = False) -> list[list[Shard]]:
    """Groups to merge, each into one file of at most about the target size.

    Runs of one tier, oldest first, are packed while the sum stays within the target. A tier of fewer than fanout runs
    waits, and so does a group of fewer, unless its sum nearly fills a target. force merges whatever is not sealed.
    """
    open_runs = sorted((s for s in shards if s.bytes < SEALED * target), key=lambda s: (s.added, s.path))
    tiers: dict[int, list[Shard]] = {}
    for s in open_runs:
        tiers.setdefault(0 if force else tier(s.bytes, fanout), []).append(s)
    groups = []
    for runs in tiers.values():
        if len(runs) < (2 if force else fanout):
            continue
        group: list[Shard] = []
        for s in [*runs, None]:
            if s is None or (group and sum(x.bytes for x in group) + s.bytes > target):
                if len(group) >= (2 if force else fanout) or (len(group) > 1 and sum(x.bytes for x in group) >= SEALED * target):
                    groups.append(group)
                group = []
            if s is not None:
                group.append(s)
    return groups


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def versions(self) -> list[int]:
        at = self._path("manifest")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest version, or the one named: {"version", "schema", "shards"}."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> bool:
        """False if another writer has made this version."""
        self.fs.mkdirs(self._path("manifest"))
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{version:010d}.json")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:  # without the option to overwrite, the rename itself fails if the version is there
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, none)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _files(self, folder: str) -> list[tuple[str, int]]:
        at = self._path(folder)
        found = [(s.getPath(), s.getLen()) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        out = []
        for path, size in found:
            if path.getName().endswith(".parquet"):
                out.append((f"{folder}/{path.getName()}", size))
            elif "=" in path.getName():
                out += self._files(f"{folder}/{path.getName()}")
        return sorted(out)

    def append(self, df: DataFrame, rows_per_shard: int = ROWS_PER_ARRIVAL) -> int:
        """Adds the rows as shards of at most rows_per_shard rows; returns the new version."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        files = self._files(folder)
        while True:
            now = self.manifest()
            schema = df.schema.json()
            if now["schema"] and [(f["name"], f["type"]) for f in json.loads(now["schema"])["fields"]] != [(f["name"], f["type"]) for f in json.loads(schema)["fields"]]:
                raise ValueError("the arrival has other columns than the store")
            new = [Shard(p, n, now["version"] + 1) for p, n in files]
            if self._commit(now["version"] + 1, now["schema"] or schema, now["shards"] + new):
                return now["version"] + 1

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, force: bool = False) -> int:
        """Merges what the plan names and commits; returns the version, the old one if there was nothing to merge."""
        now = self.manifest()
        groups = plan(now["shards"], target, fanout, force)
        if not groups:
            return now["version"]
        folder = f"data/{uuid.uuid4().hex}"
        rows = self.spark.read.schema(self._schema(now)).parquet(*(f"{self.root}/{s.path}" for g in groups for s in g))
        merge = free("merge", rows.columns)
        named = self._with_file(rows, [(s.path.rpartition("/")[2], k) for k, g in enumerate(groups) for s in g], f"{merge} int")
        named.repartitionById(len(groups), merge).write.option("compression", "zstd").partitionBy(merge).parquet(f"{self.root}/{folder}")
        gone = {s.path for g in groups for s in g}
        files = self._files(folder)
        while True:
            now = self.manifest()
            if not gone <= {s.path for s in now["shards"]}:
                raise RuntimeError("another compaction has merged some of these shards")
            kept = [s for s in now["shards"] if s.path not in gone]
            if self._commit(now["version"] + 1, now["schema"], kept + [Shard(p, n, now["version"] + 1) for p, n in files]):
                return now["version"] + 1

    def _with_file(self, rows: DataFrame, about: list[tuple], columns: str) -> DataFrame:
        """rows of shards with what about says of each one's file name (unique, as it holds a UUID) as more columns."""
        file = free("file", [*rows.columns, *(c.split()[0] for c in columns.split(", "))])
        table = self.spark.createDataFrame(about, f"{file} string, {columns}")
        named = rows.withColumn(file, F.element_at(F.split(F.input_file_name(), "/"), -1))
        return named.join(F.broadcast(table) if len(about) <= BROADCAST_FILES else table, file).drop(file)

    @staticmethod
    def _schema(manifest: dict):
        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with _metadata, so a row's shard can be told."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store has no version")
        if not now["shards"]:
            return self.spark.createDataFrame([], self._schema(now))
        return self.spark.read.schema(self._schema(now)).parquet(*(f"{self.root}/{s.path}" for s in now["shards"]))

    def members(self, key: str, version: int | None = None) -> DataFrame:
        """key, shard (path below the store's folder), shard_tier, version of every row."""
        now = self.manifest(version)
        if not now["shards"]:
            return self.read(version).select(key, F.lit("").alias("shard"), F.lit(0).alias("shard_tier"), F.lit(now["version"]).alias("version"))
        rows = self.read(version).select(F.col(f"`{key}`").alias("__key"))
        named = self._with_file(rows, [(s.path.rpartition("/")[2], s.path, tier(s.bytes)) for s in now["shards"]], "shard string, shard_tier int")
        return named.select(F.col("__key").alias(key), "shard", "shard_tier", F.lit(now["version"]).alias("version"))

    def vacuum(self, grace_s: float = GRACE_S) -> int:
        """Deletes data files over grace_s old that the newest version doesn't name; older versions can't be read afterwards."""
        live, n = {s.path for s in self.manifest()["shards"]}, 0
        at = self._path("data")
        for folder in self.fs.listStatus(at) if self.fs.exists(at) else []:
            for path, _ in self._files(f"data/{folder.getPath().getName()}"):
                if path not in live and self.fs.getFileStatus(self._path(path)).getModificationTime() <= 1000 * (time.time() - grace_s):
                    n += bool(self.fs.delete(self._path(path), False))
        return n
