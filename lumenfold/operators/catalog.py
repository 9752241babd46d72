"""The catalog: cleaning, duplicates, quality flags, rules, ids and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import taxonomy, text
from lumenfold.operators.numbering import numbered


def cleaned(raw: DataFrame, column: str = "raw_facet") -> DataFrame:
    """raw with the cleaning's columns added; a null name counts as empty."""
    return raw.withColumn(column, F.coalesce(column, F.lit(""))).withColumn("__m", text.clean(F.col(column))).select("*", "__m.*").drop("__m")


def flagged(cleaned_rows: DataFrame, order: str = "pos", column: str = "raw_facet") -> DataFrame:
    """Adds is_duplicate (the same raw or non-empty normalized name stands before) and quality_flag; order is unique.

    The first place of each name is a partial aggregation, and it is joined back by the place, not by the name, so that
    a name that most rows have, as the blank one may be, is never one task.
    """
    firsts = [cleaned_rows.groupBy(c).agg(F.min(order).alias("__first")).select("__first", F.lit(raw).alias("__is_raw")) for c, raw in ((column, True), ("normalized_facet", False))]
    places = firsts[0].unionByName(firsts[1]).groupBy("__first").agg(F.bool_or("__is_raw").alias("__raw"), F.bool_or(~F.col("__is_raw")).alias("__name"))
    joined = cleaned_rows.join(places, F.col(order) == F.col("__first"), "left")
    again = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    duplicate = again("__raw") | ((F.col("normalized_facet") != "") & again("__name"))
    meta = F.struct("is_blank", "is_header", "has_numeric_prefix", "encoding_repaired", "camelcase_reformatted")
    return joined.withColumn("is_duplicate", duplicate).drop("__first", "__raw", "__name").withColumn("quality_flag", text.quality_flag(meta, F.col("is_duplicate")))


def classified(cleaned_rows: DataFrame) -> DataFrame:
    kind = taxonomy.classify(F.col("normalized_facet"), F.col("is_blank"), F.col("is_header"))
    return cleaned_rows.withColumn("__k", kind).select("*", "__k.*").drop("__k")


def with_ids(rows: DataFrame, order: str = "pos") -> DataFrame:
    return numbered(rows, order, "__n").withColumn("facet_id", F.format_string("FACET_%03d", F.col("__n"))).drop("__n")


def build(raw: DataFrame, order: str = "pos") -> DataFrame:
    """raw: pos (numeric, unique), raw_facet. The enriched catalog, with pos and is_duplicate beside its ten columns."""
    made = classified(flagged(cleaned(with_ids(raw, order)), order))  # numbered first: the jobs that count rows read no more than the raw ones
    return made.select(*(c for c in made.columns if c != "facet_id"), "facet_id")


def statistics(catalog: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(c)
    return catalog.agg(
        F.count("*").alias("total_rows"), n(F.col("quality_flag") == "valid").alias("valid_rows"), n(F.col("quality_flag") == "header_row").alias("header_rows"),
        n(F.col("quality_flag") == "blank").alias("malformed_rows"), n(F.col("is_duplicate")).alias("duplicates"),
        n(F.col("conversation_observable")).alias("observable_rows"), n(~F.col("conversation_observable")).alias("unobservable_rows"),
    )


def audit(catalog: DataFrame) -> DataFrame:
    """Counts of the flags and the share of observable entries in percent."""
    flags = ["blank", "duplicate", "header_row", "number_prefix_stripped", "encoding_repaired", "camelcase_reformatted", "valid"]
    counts = catalog.agg(F.count("*").alias("total"), *(F.count_if(F.col("quality_flag") == f).alias(f"n_{f}") for f in flags), F.count_if(F.col("conversation_observable")).alias("observable"))
    share = F.round(F.try_divide(F.col("observable"), F.col("total")) * 100, 2)
    return counts.withColumn("observable_pct", share).withColumn("unobservable_pct", F.round(100 - share, 2))


def distributions(catalog: DataFrame, columns: tuple[str, ...] = ("facet_type", "sensitivity", "quality_flag")) -> DataFrame:
    """column, value, n for each column: one pass, one shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    return catalog.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def lookup(catalog: DataFrame, facet_id: str) -> DataFrame:
    """The entry of an id in any case; no rows if there is none."""
    return catalog.filter(F.col("facet_id") == facet_id.upper()).limit(1)


def observable(catalog: DataFrame, column: str = "conversation_observable") -> DataFrame:
    """Entries that may be retrieved: those flagged true, all where the flag is missing; a null flag is not true."""
    return catalog.filter(F.coalesce(F.col(column), F.lit(False))) if column in catalog.columns else catalog
