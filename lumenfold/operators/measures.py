"""Counts and times of a run, from the passes that make its tables.

A step writes a table, and its rows are counted on their way into it: the observation stands right at the write, whose tasks
count once each, also where a lost executor makes Spark run some again. No second job reads the table for its counts.
Only the numbers come to the driver, some for each step.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import stored


class Run:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._counts: list[tuple[str, int, str, int]] = []
        self._times: list[tuple[str, int, float]] = []

    def step(self, component: str, df: DataFrame, **counts: Column) -> DataFrame:
        """The rows as a stored table. counts: aggregates of whole numbers to take beside the number of rows. A component
        may have several steps; they are numbered by call from 1."""
        seen, call = Observation(), 1 + sum(c == component for c, _, _ in self._times)
        started = time.perf_counter()
        made = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in counts.items())))
        self._times.append((component, call, 1000 * (time.perf_counter() - started)))
        got = seen.get
        self._counts += [(component, call, name, int(got.get(name) or 0)) for name in ("rows", *counts)]
        return made

    def counts(self) -> DataFrame:
        """component, call, measure, value of all steps so far."""
        return self.spark.createDataFrame(self._counts, "component string, call int, measure string, value long")

    def times(self) -> DataFrame:
        """component, call, ms: what ``evaluation.component_means`` takes, with ms by component."""
        return self.spark.createDataFrame(self._times, "component string, call int, ms double")
