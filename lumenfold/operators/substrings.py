"""Pairs of texts of which one holds the other, by a join on runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: Column | int = GRAM) -> Column:
    """The different runs of n characters, none of a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n)))


def substring_pairs(texts: DataFrame, text: str, wanted: DataFrame, want: str, gram: int = GRAM) -> DataFrame:
    """Columns of texts and wanted of all pairs in which the text holds the wanted string (equal ones too).

    A text that holds a string holds all its runs of ``gram`` characters, so only texts with the string's rarest run are tried;
    a string with a run that no text has is in none. Shorter strings are runs themselves. Strings without a character,
    which all texts hold, and nulls have no pairs. No column may be in both tables.
    """
    texts = texts.filter(F.length(text) > 0)
    sizes = F.transform(F.sequence(F.lit(1), F.least(F.lit(gram), F.length(text))), lambda n: grams(F.col(text), n))
    index = texts.select("*", F.explode(F.flatten(sizes)).alias("__gram"))
    asked = wanted.filter(F.length(want) > 0).select(want).distinct()
    runs = asked.select(want, F.explode(grams(F.col(want), F.least(F.lit(gram), F.length(want)))).alias("__gram"))
    counts = index.join(runs.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = runs.join(counts, "__gram", "left").groupBy(want).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__r"))
    tried = rarest.filter("__r.n > 0").select(F.col(want).alias("__want"), F.col("__r.gram").alias("__gram")).join(index, "__gram")
    held = tried.filter(F.col(text).contains(F.col("__want"))).drop("__gram")
    return held.join(wanted, F.col("__want") == F.col(want)).drop("__want")
