"""Consecutive numbers over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE, MAX_RANGES = 200_000, 2_000


def range_of(key: Column, cuts: list[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted cuts are at or below the key: a binary search of literals."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key >= F.lit(cuts[mid]), range_of(key, cuts, mid + 1, high)).otherwise(range_of(key, cuts, low, mid))


def cuts_of(df: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Bounds of ranges of the key with about as many rows each; none for a small table."""
    parts = min(MAX_RANGES, df.count() // rows_per_range + 1)
    return sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []


def numbered(df: DataFrame, key: str, to: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds 1, 2, ... by ascending key (numeric, without ties or nulls).

    Ranges of the key are numbered on their own and shifted by how many rows lie before them; only the ranges' bounds
    and counts come to the driver.
    """
    cuts = cuts_of(df, key, rows_per_range)
    part = range_of(F.col(key).cast("double"), cuts)
    ranged = df.withColumn("__range", part)
    before, total = [], 0
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()} if cuts else {}
    for i in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(i, 0)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(key)).cast("long")
    return ranged.withColumn(to, own + F.get(F.lit(before), F.col("__range"))).drop("__range")
