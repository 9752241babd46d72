"""Sessions and settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """What a service around the engine would read from its environment (LUMENFOLD_*)."""

    retrieval_k: int = 10
    batch_size: int = 10
    reranker_enabled: bool = False
    rerank_pool: int = 30
    backend: str = "rules"
    endpoint: str = ""
    timeout_s: float = 60.0
    max_tokens: int = 500
    temperature: float = 0.0
    max_chars: int = 10_000
    max_top_k: int = 50

    @classmethod
    def from_env(cls) -> Settings:
        read = {}
        for name, kind in cls.__annotations__.items():
            value = os.environ.get(f"LUMENFOLD_{name.upper()}")
            if value is not None:
                read[name] = value.lower() in ("1", "true", "yes") if kind == "bool" else {"int": int, "float": float, "str": str}[kind](value)
        return cls(**read)


def session(name: str = "lumenfold", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt out to all cores. Such a table often lies in one row group, which one task reads; what
    is heavy on each row then runs in that task alone. Larger tables have row groups enough and stay where they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode, where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. A catalog is built once and then read by every plan that uses it, which
    keeps those plans small: the rules' long expressions are not repeated in each of their branches."""
    at = f"{shared_dir(df.sparkSession)}/lumenfold/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
