"""A versioned store of vectors: the last writer of a key wins, readers see one version.

A write adds a folder of rows (backend, doc_id, text_hash, vector, deleted) and then a version: one JSON file that names the
folders in order, put in place by a rename that fails where that version exists, so of two writers one starts again on
the newer version. (File systems whose rename replaces what is there, as object stores' do, need a single writer.) A reader
takes the folders of one version and, for each (backend, doc_id), the row of the last folder; a deletion is a row too.
``compact`` writes what a reader sees as one folder. Folders stay until ``vacuum`` finds them in none of the versions that it
keeps and older than its grace time.

Only the names of folders come to the driver. Within one write a doc_id's row of the greatest text_hash counts. Null ids are
left out, as no reader asks for them.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "backend string, doc_id {id}, text_hash string, vector array<double>, deleted boolean"
GRACE_S = 24 * 3600.0


class VectorStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def versions(self) -> list[int]:
        at = self._path("versions")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "folders", "id"} of the newest version or the one named; version 0 has nothing."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "folders": [], "id": None}
        stream = self.fs.open(self._path(f"versions/{version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, made: dict) -> bool:
        """False if another writer has made this version."""
        draft, to = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{made['version']:010d}.json")
        out = self.fs.create(draft, True)
        out.write(json.dumps(made).encode())
        out.close()
        self.fs.mkdirs(to.getParent())
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        keep = self.spark.sparkContext._gateway.new_array(options, 1)
        keep[0] = options.valueOf("NONE")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
        try:
            context.rename(draft, to, keep)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def _add(self, rows: DataFrame) -> int:
        folder, kind = uuid.uuid4().hex, dict(rows.dtypes)["doc_id"]
        rows.write.parquet(f"{self.root}/data/{folder}")
        while True:
            now = self.manifest()
            if now["id"] not in (None, kind):
                raise ValueError(f"the store's ids are {now['id']}, not {kind}")
            if self._commit({"version": now["version"] + 1, "folders": [*now["folders"], folder], "id": kind}):
                return now["version"] + 1

    def write(self, vectors: DataFrame, backend: str = "model") -> int:
        """vectors: doc_id, text_hash, vector. Returns the new version."""
        return self._add(vectors.select(F.lit(backend).alias("backend"), "doc_id", "text_hash", F.col("vector").cast("array<double>").alias("vector"), F.lit(False).alias("deleted")))

    def delete(self, ids: DataFrame, backend: str = "model") -> int:
        """ids: doc_id. Their vectors are gone from the new version on."""
        none = F.lit(None)
        return self._add(ids.select(F.lit(backend).alias("backend"), "doc_id", none.cast("string").alias("text_hash"), none.cast("array<double>").alias("vector"), F.lit(True).alias("deleted")))

    def _last(self, found: dict) -> DataFrame | None:
        """The last row of each key of a version."""
        if not found["folders"]:
            return None
        schema, rows = COLUMNS.format(id=found["id"]), None
        for k, folder in enumerate(found["folders"]):  # as many as writes since the last compaction
            own = self.spark.read.schema(schema).parquet(f"{self.root}/data/{folder}").withColumn("__at", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        last = F.max_by(F.struct("text_hash", "vector", "deleted"), F.struct("__at", ~F.col("deleted"), "text_hash"))
        return rows.filter("doc_id IS NOT NULL").groupBy("backend", "doc_id").agg(last.alias("r")).select("backend", "doc_id", "r.*").filter("NOT deleted")

    def read(self, backend: str = "model", version: int | None = None) -> DataFrame | None:
        """doc_id, text_hash, vector of a version; None where nothing was ever written."""
        rows = self._last(self.manifest(version))
        return None if rows is None else rows.filter(F.col("backend") == backend).select("doc_id", "text_hash", "vector")

    def compact(self) -> int:
        """One folder for all; writes that were made meanwhile stay behind it."""
        before = self.manifest()
        if len(before["folders"]) < 2:
            return before["version"]
        folder = uuid.uuid4().hex
        self._last(before).write.parquet(f"{self.root}/data/{folder}")
        while True:
            now = self.manifest()
            if now["folders"][: len(before["folders"])] != before["folders"]:  # compacted by another
                return now["version"]
            if self._commit({"version": now["version"] + 1, "folders": [folder, *now["folders"][len(before["folders"]) :]], "id": now["id"]}):
                return now["version"] + 1

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> list[str]:
        """Deletes folders that the last ``keep`` versions don't name and that are older than the grace time."""
        kept = {f for v in self.versions()[-keep:] for f in self.manifest(v)["folders"]}
        old = [s.getPath() for s in self.fs.listStatus(self._path("data")) if s.getModificationTime() <= (time.time() - grace_s) * 1000] if self.fs.exists(self._path("data")) else []
        gone = [p for p in old if p.getName() not in kept]
        for p in gone:
            self.fs.delete(p, True)
        return [p.getName() for p in gone]
