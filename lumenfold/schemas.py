"""Schemas of the engine's tables and the checks on a result row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("raw_facet", T.StringType())])

CATALOG = T.StructType(
    [
        T.StructField("facet_id", T.StringType()),
        T.StructField("raw_facet", T.StringType()),
        T.StructField("normalized_facet", T.StringType()),
        T.StructField("facet_type", T.StringType()),
        T.StructField("conversation_observable", T.BooleanType()),
        T.StructField("sensitivity", T.StringType()),
        T.StructField("scoring_definition", T.StringType()),
        T.StructField("scoring_anchors", T.StringType()),
        T.StructField("abstention_reason", T.StringType()),
        T.StructField("quality_flag", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("facet_id", T.StringType()),
        T.StructField("facet", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

ANNOTATION = "struct<facet_id:string,facet:string,expected_status:string,expected_score:int,human_rationale:string>"
REFERENCE_SET = f"conversation_id string, conversation_text string, category string, annotations array<{ANNOTATION}>"
CASES = "test_id string, text string, expected_facet string, expected_status string, expected_score double"

STATUSES = ("scored", "insufficient_evidence", "not_observable", "invalid_facet", "inference_error")
ABSTAINED = ("insufficient_evidence", "not_observable")


def valid_result(status: Column, score: Column, confidence: Column, *required: Column) -> Column:
    """The invariants of a result: known status, 1 to 5 iff scored, confidence 0 to 1, and no required field missing."""
    scored = status == "scored"
    ok = status.isin(*STATUSES) & confidence.between(0.0, 1.0) & F.when(scored, score.between(1, 5)).otherwise(score.isNull())
    for c in required:
        ok = ok & c.isNotNull()
    return F.coalesce(ok, F.lit(False))
