"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A-Z to a-z on UTF-8 bytes; every other byte stays, so multi-byte characters are untouched.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Rows of text sent to a Python worker at once. Long texts make a batch large, so the count is low.
ROWS_PER_BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (null: none)."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def kept_names(keep: Iterable[str], made: Iterable[str]) -> tuple[str, ...]:
    """Names for kept columns beside those made: each its own, or with _kept added until no column has it."""
    keep = tuple(keep)
    taken = {m.lower() for m in made}
    free = [k if k.lower() not in taken else None for k in keep]
    taken |= {k.lower() for k in free if k is not None}
    for i, k in enumerate(keep):
        if free[i] is None:
            while k.lower() in taken:
                k += "_kept"
            free[i] = k
            taken.add(k.lower())
    return tuple(free)


def carried(docs: DataFrame, keep: tuple[str, ...], text: str, made: str) -> tuple[DataFrame, tuple[str, ...], StructType]:
    """The columns of keep and, last, the text; their names; the schema of them and of made, the DDL of the columns to come.
    A kept column with the name of one of those is called NAME_kept, so no name clashes."""
    new = StructType.fromDDL(made).fields
    names = kept_names(keep, (*(f.name for f in new), "__text"))
    kept = [StructField(n, docs.schema[k].dataType) for k, n in zip(keep, names, strict=True)]
    return docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("__text")), names, StructType([*kept, *new])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with small batches, so that a worker never holds many long texts at once. All operators of this
    subpackage leave the session at the same batch size, so a plan's doesn't depend on what ran before."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # a worker waits for its next task with less

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(lean, schema)


def unit(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def least_hashed(df: DataFrame, h: Column, n: int, total: int, *ties: str) -> DataFrame:
    """The n rows of the least hashes of total ones. Rows that are surely not among them are left out first, so that a
    partition sends on its share of some 4 n rows and not n."""
    return df.filter(unit(h) <= 4 * n / max(total, 1)).orderBy(unit(h), *ties).limit(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        now = spark.sparkContext.getCheckpointDir()
        if not now and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = now if now else tempfile.mkdtemp(prefix="lumenfold-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table below the shared folder."""
    return f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


#: Deletes a statement's shuffle files when it ends, and not when the driver's collector comes to it.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors. The shuffles that
    made it are deleted then, as no later plan reads them."""
    spark = df.sparkSession
    at, before = scratch(spark, name), spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
