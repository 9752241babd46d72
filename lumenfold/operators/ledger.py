"""Model calls that a lost task doesn't repeat: answers are kept by prompt in a ledger in a shared folder.

Equal prompts are asked once. They go to ``buckets`` by their hash, a task a bucket. It reads what the bucket's folder has,
calls the backend for the others with at most ``max_open`` calls open, and adds each ``every`` answers to the folder as a
file of JSON lines, put in place by a rename. So a task that is tried again, a speculative copy and a later run find the
answers there. What is called again are calls that failed and, after a kill, the answers that weren't in a file yet.

A task holds the answers of one bucket; take as many buckets as give each some thousand prompts. Another number of buckets
is another ledger. The folder is a path or a URI that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.scoring import SYSTEM_PROMPT


class Bucket:
    """The answers of one bucket, in files that never change."""

    def __init__(self, folder: str, number: int):
        self.number = number
        self.fs, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
        self.at = f"{at}/{number:06d}"

    def read(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if info.path.endswith(".jsonl"):
                with self.fs.open_input_stream(info.path) as f:
                    found.update(json.loads(line) for line in f.read().split(b"\n") if line)
        return found

    def add(self, answers: list[tuple[str, str]]) -> None:
        if answers:
            self.fs.create_dir(self.at, recursive=True)
            name = f"{self.at}/{uuid.uuid4().hex}"
            with self.fs.open_output_stream(f"{name}.part") as out:
                out.write("".join(json.dumps(x) + "\n" for x in answers).encode())
            self.fs.move(f"{name}.part", f"{name}.jsonl")


def key_of(prompt: Column, model: str, system: str) -> Column:
    """The hash by which an answer is kept: that of the model's name, the instructions and the prompt (null: empty)."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("m"), F.lit(system).alias("s"), F.coalesce(prompt, F.lit("")).alias("p"))), 256)


def complete(prompted: DataFrame, backend: Callable[[str, str], str], folder: str, model: str = "", system: str = SYSTEM_PROMPT, max_open: int = 8, every: int = 16, buckets: int = 256) -> DataFrame:
    """conv_id, batch, raw_output, error, as ``scoring.complete`` has them, with answers kept in the folder.

    backend is called from several threads of a task. A failed call is the row's error and isn't kept. Repeated rows stay,
    each with the one answer; model names the backend, so that another one's answers aren't taken.
    """
    place = f"{folder.rstrip('/')}/{buckets}"

    def call(prompt: str) -> tuple[str | None, str | None]:
        try:
            return backend(system, prompt), None
        except Exception as e:  # any failure of a call is its prompt's result, as in the contract of inference_error
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, bucket, known = ThreadPoolExecutor(max_open), None, {}
        try:
            for frame in frames:
                for number, rows in frame.groupby("bucket"):
                    if bucket is None or bucket.number != number:
                        bucket = Bucket(place, int(number))
                        known = bucket.read()
                    got, fresh = {k: (known[k], None) for k in rows["key"] if k in known}, []
                    calls = {pool.submit(call, p): k for k, p in zip(rows["key"], rows["prompt"], strict=True) if k not in known}
                    try:
                        for done in as_completed(calls):
                            got[calls[done]] = raw, error = done.result()
                            if error is None and raw is not None:
                                fresh.append((calls[done], raw))
                            if len(fresh) >= every:
                                bucket.add(fresh)
                                fresh = []
                    finally:
                        bucket.add(fresh)
                    yield pd.DataFrame({"key": rows["key"], "raw_output": [got[k][0] for k in rows["key"]], "error": [got[k][1] for k in rows["key"]]})
        finally:
            pool.shutdown(cancel_futures=True)

    rows = prompted.select("conv_id", "batch", key_of(F.col("prompt"), model, system).alias("key"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    asked = rows.groupBy("key").agg(F.any_value("prompt").alias("prompt")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    answers = dealt.mapInPandas(run, "key string, raw_output string, error string")
    return rows.drop("prompt").join(answers, "key").select("conv_id", "batch", "raw_output", "error")
