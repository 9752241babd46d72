"""Cleaning, rules and tokenizers on literals."""

from pyspark.sql import functions as F

from lumenfold.functions import taxonomy, text
from lumenfold.operators import catalog as cat


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_clean(spark):
    got = values(spark, text.clean, ["800. Sufi practice", "12. x", "Democratic Leadership:", "SelfEsteem", "Selfcontrol", "fooBar", None, "  ", "a�\u0080b", "two  gaps", "naïve", "a::"])
    assert [g["normalized_facet"] for g in got] == ["Sufi practice", "12. x", "Democratic Leadership", "Self Esteem", "Self Control", "foo Bar", "", "", "a–b", "two – gaps", "naïve", "a:"]
    assert [g["is_header"] for g in got] == [False, False, True, *[False] * 8, True]
    assert [g["has_numeric_prefix"] for g in got][:2] == [True, False]
    assert [g["camelcase_reformatted"] for g in got][3:6] == [True] * 3
    assert [g["encoding_repaired"] for g in got][8:11] == [True] * 3
    assert got[6]["is_blank"] and got[7]["is_blank"]


def test_taxonomy(spark):
    names = ["Sufi practice", "Parathyroid hormone", "Reading hours", "Working memory", "Burnout", "Room temperature", "Hostility", "Kindness", "Bahá'í metric level"]
    got = values(spark, lambda c: taxonomy.classify(c, F.lit(False), F.lit(False)), names)
    assert [g["facet_type"] for g in got] == ["esoteric_spiritual", "medical_biomarker", "external_biographical", "cognitive_skill_test", "psychological_trait", "external_biographical", "conversational_trait", "conversational_trait", "esoteric_spiritual"]
    assert [g["sensitivity"] for g in got][-3:] == ["medium", "low", "sensitive_personal"]
    assert got[7]["scoring_anchors"].startswith('{"high": "Demonstrates clear, consistent evidence of high Kindness through')
    assert values(spark, taxonomy.json_string, ['a"b\\c', "é–"]) == ['"a\\"b\\\\c"', '"\\u00e9\\u2013"']


def test_terms(spark):
    assert values(spark, text.terms, ["HonestyHumility self-aware café", "", None]) == [["honesty", "humility", "self", "aware", "honestyhumility", "honesty_humility", "humility_self", "self_aware"], [], []]
    assert values(spark, text.word_tokens, ["Été à_1 x"]) == [["été", "à_1", "x"]]
    assert values(spark, text.expand_query, ["We voted on it", None]) == ["We voted on it collaboration consensus democratic group decision teamwork voted", ""]


def test_names_and_limits(spark):
    assert values(spark, text.display_name, [" A: ", "A::", None]) == ["A", "A:", ""]
    assert values(spark, text.match_key, ["ABC::", " x "]) == ["abc", "x"]
    assert values(spark, lambda c: text.input_error(c, 5), ["", "  ", None, "abcdef", "abc"]) == ["blank", "blank", "blank", "too long", None]
    assert values(spark, text.snippet, ["a" * 51, "b"]) == ["a" * 50 + "...", "b"]


def test_catalog(spark):
    rows = [(0, "Democratic Leadership:"), (1, "800. Sufi practice"), (2, "Risk"), (3, "Risk"), (4, None), (5, "SelfEsteem"), (6, "Self Esteem"), (7, "")]
    got = cat.build(spark.createDataFrame(rows, "pos long, raw_facet string")).orderBy("pos").collect()
    assert [g.facet_id for g in got][:2] == ["FACET_001", "FACET_002"]
    assert [g.quality_flag for g in got] == ["header_row", "number_prefix_stripped", "valid", "duplicate", "blank", "camelcase_reformatted", "duplicate", "blank"]
    stats = cat.statistics(spark.createDataFrame(got)).first()
    assert (stats.total_rows, stats.header_rows, stats.malformed_rows, stats.duplicates, stats.observable_rows) == (8, 1, 2, 3, 4)


def test_numbering_over_ranges(spark):
    from lumenfold.operators.numbering import numbered

    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    got = numbered(df, "k", "n", rows_per_range=300).orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 5001))


def test_observable_flags(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, conversation_observable boolean")
    assert [r.i for r in cat.observable(df).collect()] == [1]
    assert cat.observable(df.drop("conversation_observable")).count() == 3
