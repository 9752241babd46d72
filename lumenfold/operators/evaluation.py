"""Matching of names, quality metrics and failure analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import match_key
from lumenfold.operators.numbering import ROWS_PER_RANGE, cuts_of, range_of
from lumenfold.operators.substrings import substring_pairs
from lumenfold.schemas import ABSTAINED
from lumenfold.session import stored

DEFAULT_STATUS = "insufficient_evidence"


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)) * 100, digits)


# names


def resolve_names(names: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """names: name_id, name; catalog: pos, facet_id, raw_facet, normalized_facet. Adds facet_id and matched_by.

    In turn: alias, normalized name, raw name, lower-case normalized name (last entry of a name), then the first entry in
    catalog order whose lower-case name holds the wanted one. Only names that no equality resolves go into that last
    search, and only against distinct names that share their rarest three characters.
    """
    key = match_key(F.col("name"))
    wanted = names.withColumn("__key", key)
    if aliases is not None:
        wanted = wanted.join(aliases.groupBy(match_key(F.col("alias")).alias("__key")).agg(F.min("target").alias("__target")), "__key", "left")
    else:
        wanted = wanted.withColumn("__target", F.lit(None).cast("string"))
    wanted = wanted.withColumn("__name", F.coalesce("__target", "name")).withColumn("__low", match_key(F.col("__name")))
    last = lambda c, to: catalog.groupBy(c.alias(to)).agg(F.max_by("facet_id", "pos").alias(f"{to}_id"))
    out = wanted
    for column, to, own in ((F.col("normalized_facet"), "__n", "__name"), (F.col("raw_facet"), "__r", "__name"), (match_key(F.col("normalized_facet")), "__l", "__low")):
        table = last(column, to).filter(F.col(to) != "")
        out = out.join(table, out[own] == table[to], "left").drop(to)
    equal = F.coalesce("__n_id", "__r_id", "__l_id")
    rest = out.filter(equal.isNull() & (F.col("__low") != "")).select("__low").distinct()
    entries = catalog.select("pos", "facet_id", match_key(F.col("normalized_facet")).alias("__entry")).filter(F.col("__entry") != "").groupBy("__entry").agg(F.min(F.struct("pos", "facet_id")).alias("__first"))
    held = substring_pairs(entries, "__entry", rest, "__low").groupBy("__low").agg(F.min("__first").alias("__found"))
    done = out.join(held, "__low", "left")
    how = F.when(F.col("__n_id").isNotNull(), F.when(F.col("__target").isNotNull(), "alias").otherwise("normalized")).when(F.col("__r_id").isNotNull(), "raw").when(F.col("__l_id").isNotNull(), "lower").when(F.col("__found").isNotNull(), "contains").otherwise("none")
    return done.select(*names.columns, F.coalesce("__n_id", "__r_id", "__l_id", F.col("__found.facet_id")).alias("facet_id"), how.alias("matched_by"))


def contains_match(results: DataFrame, wanted: DataFrame, both_ways: bool = False, fallback: bool = False) -> DataFrame:
    """results: case_id, pos, facet; wanted: case_id, expected. Each case's first result whose name equals or holds the
    expected one (or is held by it, both_ways); with fallback its first result where none does."""
    own, want = match_key(F.col("facet")), match_key(F.col("expected"))
    hit = (own == want) | own.contains(want)
    if both_ways:
        hit = hit | want.contains(own)
    found = wanted.join(results, "case_id", "left").withColumn("__hit", F.coalesce(hit & (want != ""), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("__hit"), "pos"))
    one = found.withColumn("__n", first).filter("__n = 1")
    shown = F.col("__hit") | F.lit(fallback)
    return one.select("case_id", "expected", F.col("__hit").alias("matched"), F.when(shown, F.col("pos")).alias("pos"), F.when(shown, F.col("facet")).alias("facet"))


def harness_match(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """results: case_id, pos, facet_id, facet; wanted: case_id, facet_id (null: unknown), expected. Each case's first result
    whose name holds the expected one or is held by it, or whose id equals the expected name or the wanted id."""
    own, want, own_id = F.lower(F.trim("facet")), match_key(F.col("expected")), F.lower(F.trim("facet_id"))
    hit = ((want != "") & own.contains(want)) | ((own != "") & want.contains(own)) | (own_id == want) | (own_id == F.lower("want_id"))
    j = wanted.select("case_id", F.col("facet_id").alias("want_id"), "expected").join(results, "case_id").filter(F.coalesce(hit, F.lit(False)))
    return j.groupBy("case_id").agg(F.min(F.struct("pos", "facet_id")).alias("r")).select("case_id", "r.pos", "r.facet_id")


def in_set(targets: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """targets with is_member: whether the key is one of members'."""
    known = members.filter(F.col(on).isNotNull()).select(on).distinct().withColumn("is_member", F.lit(True))
    return targets.join(known, on, "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def result_match(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """results: case_id, pos, facet_id, facet, status; wanted: case_id, facet_id, expected. First by id, name or part of the
    id; where none fits, the first scored result."""
    w = wanted.select("case_id", F.col("facet_id").alias("want_id"), "expected")
    j = w.join(results, "case_id")
    direct = (F.col("facet_id") == F.col("want_id")) | (match_key(F.col("facet")) == match_key(F.col("expected"))) | F.col("facet_id").contains(F.col("want_id"))
    grade = F.when(direct, 1).when(F.col("status") == "scored", 2)
    best = j.withColumn("match_pass", grade).filter("match_pass is not null")
    return best.withColumn("__n", F.row_number().over(Window.partitionBy("case_id").orderBy("match_pass", "pos"))).filter("__n = 1").select("case_id", "match_pass", "pos", "facet_id")


def split_matched(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    return left.join(right, on, "left_semi"), left.join(right, on, "left_anti")


def with_predictions(annotations: DataFrame, predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Annotations with predicted_status and predicted_score: the last prediction of a key, abstention where there is none."""
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct("predicted_status", "predicted_score"), order).alias("__p"))
    joined = annotations.join(last, keys, "left")
    return joined.select(*annotations.columns, F.coalesce("__p.predicted_status", F.lit(DEFAULT_STATUS)).alias("predicted_status"), F.col("__p.predicted_score").alias("predicted_score"))


# metrics over rows of expected_status, predicted_status, expected_score, predicted_score


def _abstained(c: str) -> Column:
    return F.col(c).isin(*ABSTAINED)


def status_accuracy(rows: DataFrame) -> DataFrame:
    """n, strict and lenient accuracy in percent (the two abstentions are one when lenient)."""
    same = F.col("expected_status") == F.col("predicted_status")
    return rows.agg(F.count("*").alias("n"), percent(F.count_if(same), F.count("*")).alias("strict_pct"), percent(F.count_if(same | (_abstained("expected_status") & _abstained("predicted_status"))), F.count("*")).alias("lenient_pct"))


def abstention_prf(rows: DataFrame, lenient: bool = True) -> DataFrame:
    """Precision, recall and F1 in percent; F1 is that of the rounded two."""
    e, p = _abstained("expected_status"), _abstained("predicted_status")
    right = e & p if lenient else p & (F.col("expected_status") == F.col("predicted_status"))
    base = rows.agg(F.count_if(right).alias("tp"), F.count_if(p).alias("n_pred"), F.count_if(e).alias("n_exp"))
    pr = lambda whole: F.round(F.col("tp") / F.greatest(F.col(whole), F.lit(1)) * 100, 2)
    scored = base.select("tp", "n_pred", "n_exp", pr("n_pred").alias("precision_pct"), pr("n_exp").alias("recall_pct"))
    return scored.withColumn("f1_pct", F.round(2 * F.col("precision_pct") * F.col("recall_pct") / F.greatest(F.col("precision_pct") + F.col("recall_pct"), F.lit(1e-5)), 2))


def score_error(rows: DataFrame) -> DataFrame:
    """Mean absolute error, exact and within one over pairs with both scores; exact also over all expected to be scored."""
    gap = F.abs(F.col("predicted_score") - F.col("expected_score"))
    both, expected = F.count_if(gap.isNotNull()), F.count_if(F.col("expected_status") == "scored")
    return rows.agg(
        both.alias("n_pairs"), F.round(F.coalesce(F.avg(gap), F.lit(0.0)), 4).alias("mae"), percent(F.count_if(gap == 0), both).alias("exact_pct"), percent(F.count_if(gap <= 1), both).alias("within_one_pct"),
        percent(F.count_if(gap == 0), expected).alias("exact_of_expected_pct"),
    )


def false_scoring(rows: DataFrame) -> DataFrame:
    """Entries that can't be observed but were scored: count, share of such entries and of all."""
    un = F.col("expected_status") == "not_observable"
    wrong = F.count_if(un & (F.col("predicted_status") == "scored"))
    return rows.agg(wrong.alias("n_false"), percent(wrong, F.count_if(un)).alias("pct_of_unobservable"), percent(wrong, F.count("*")).alias("pct_of_all"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected_status", "predicted_status").agg(F.count("*").alias("n"))


def score_distribution(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("predicted_score").isNotNull()).groupBy("predicted_score").agg(F.count("*").alias("n"))


def failure_category(mock: bool = True) -> Column:
    """The seven-way category of a row that differs; null where it doesn't."""
    e, p, es, ps = F.col("expected_status"), F.col("predicted_status"), F.col("expected_score"), F.col("predicted_score")
    differs = (p != e) | ~ps.eqNullSafe(es)
    return F.when(~differs, None).when(p == "inference_error", "inference_error").when((e == "not_observable") & (p == "scored"), "false_scoring").when((e == "scored") & (p == "insufficient_evidence"), "mock_backend_limitation" if mock else "incorrect_abstention").when((e == "scored") & ~ps.eqNullSafe(es), "wrong_scoring").otherwise("incorrect_abstention")


def lettered_category() -> Column:
    """The lettered category, from status, score, whether the target is observable, and its rank."""
    e, p, es, ps, rank = F.col("expected_status"), F.col("predicted_status"), F.col("expected_score"), F.col("predicted_score"), F.col("target_rank")
    differs = (p != e) | ((e == "scored") & ~ps.eqNullSafe(es))
    hidden = ~F.coalesce(F.col("target_observable"), F.lit(True))
    return (
        F.when(~differs, None).when(hidden & (p == "scored"), "B. Taxonomy/pre-filtering failure").when(hidden, "F. Benchmark/evaluation bug").when(rank.isNull() | (rank > 30), "A. Retrieval failure")
        .when((e == "scored") & (p == "insufficient_evidence"), "H. Mock backend limitation").when((e == "scored") & (p == "scored") & ~ps.eqNullSafe(es), "C. Scoring failure")
        .when(e.isin(*ABSTAINED) & (p == "scored"), "D. Abstention failure").otherwise("H. Mock backend limitation")
    )


def harness_category() -> Column:
    """The six-way category, from expected_status, predicted_status, predicted_score, parse_state, resolved, target_rank, valid."""
    e, positive = F.col("expected_status"), F.coalesce(F.col("predicted_score"), F.lit(0.0)) > 0
    scored = (F.col("predicted_status") == "scored") | positive
    missed = (
        F.when(F.col("parse_state") == "parse_error", "PARSER_FAILURE").when(~F.col("resolved"), "FACET_RESOLUTION_FAILURE").when(F.col("target_rank") > 10, "RETRIEVAL_FAILURE").when(~F.col("valid"), "GOLD_LABEL_FAILURE").otherwise("MODEL_SEMANTIC_FAILURE")
    )
    return F.when((e == "scored") & ~(scored & positive), missed).when(e.isin("not_observable", "abstained") & scored & positive, "MODEL_SEMANTIC_FAILURE").otherwise("NONE")


def conditioned(rows: DataFrame, depth: int = 30) -> DataFrame:
    """Status accuracy over all rows and over those whose target was retrieved."""
    got = F.coalesce(F.col("target_rank") <= depth, F.lit(False))
    same = F.col("expected_status") == F.col("predicted_status")
    return rows.agg(F.count("*").alias("n"), F.count_if(got).alias("n_retrieved"), percent(F.count_if(same), F.count("*")).alias("overall_pct"), percent(F.count_if(same & got), F.count_if(got)).alias("when_retrieved_pct"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 10, "retrieved").when(rank <= 30, "ranking_failure").otherwise("retrieval_miss")


# metrics over rankings


def recall_at(candidates: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """Set recall in percent, averaged over queries with a relevant document. candidates: query_id, doc_id, rank."""
    return per_query_recall(candidates, relevant, depths).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(f"r{k}") * 100, 2).alias(f"recall_{k}") for k in depths))


def per_query_recall(candidates: DataFrame, relevant: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    hits = relevant.select("query_id", "doc_id").distinct().join(candidates.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(*(F.try_divide(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"r{k}") for k in depths))


def first_relevant(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, rank of the first relevant candidate or null."""
    hits = relevant.select("query_id", "doc_id").distinct().join(candidates.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.min("rank").alias("rank"))


def mrr(first: DataFrame, cut: int | None = None) -> DataFrame:
    ok = F.col("rank").isNotNull() & ((F.col("rank") <= cut) if cut else F.lit(True))
    return first.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(ok, 1.0 / F.col("rank")).otherwise(0.0)), 4).alias("mrr"))


def ndcg(first: DataFrame, k: int = 10) -> DataFrame:
    """With one relevant document: 1 / log2(rank + 1)."""
    gain = F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)
    return first.agg(F.count("*").alias("n_queries"), F.round(F.avg(gain), 4).alias(f"ndcg_{k}"))


def hit_rates(ranks: DataFrame, depths: tuple[int, ...] = (1, 5, 10, 20, 30), rank: str = "target_rank") -> DataFrame:
    """Share of cases with the target within each depth, in percent, and MRR within 100."""
    hit = lambda k: F.round(F.avg((F.coalesce(F.col(rank), F.lit(999)) <= k).cast("double")) * 100, 2).alias(f"recall_at_{k}")
    inverse = F.when(F.col(rank) <= 100, 1.0 / F.col(rank)).otherwise(0.0)
    return ranks.agg(F.count("*").alias("n"), *map(hit, depths), F.round(F.avg(inverse), 4).alias("mrr"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """key and, for each name of shares, the exact percentile of value (double) by linear interpolation; null values don't count.

    Equal values are counted first, then each key's values are ranked in ranges of the value, so that no task holds all
    values of a key.
    """
    counted = stored(rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(value).alias("__x")).agg(F.count("*").alias("__c")))
    ranged = counted.withColumn("__r", range_of(F.col("__x"), cuts_of(counted, "__x", rows_per_range)))
    whole = Window.partitionBy("__key")  # a row a range
    sums = ranged.groupBy("__key", "__r").agg(F.sum("__c").alias("__s"))
    sums = sums.select("__key", "__r", F.sum("__s").over(whole).alias("__n"), (F.sum("__s").over(whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")).alias("__before"))
    within = F.sum("__c").over(Window.partitionBy("__key", "__r").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.join(sums, ["__key", "__r"]).withColumn("__end", F.col("__before") + within)  # places from 0: end - c to end - 1
    out, made = [], []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("__n") - 1)
        low, high = (F.max(F.when((i >= F.col("__end") - F.col("__c")) & (i < F.col("__end")), F.col("__x"))) for i in (F.floor(at), F.ceil(at)))
        out += [low.alias(f"__low_{name}"), high.alias(f"__high_{name}")]
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        made.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return ranked.groupBy("__key", "__n").agg(*out).select(F.col("__key").alias(key), *made)


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, median and exact percentiles by linear interpolation; null is a group of its own."""
    keyed = rows.select(F.struct(F.lit(0).alias("__0"), *by).alias("__group"), F.col(value).cast("double").alias("__value"))
    basic = [F.count("__value").alias("n"), F.round(F.avg("__value"), 4).alias("mean")]
    plain = keyed.groupBy("__group").agg(*basic) if by else keyed.agg(*basic).withColumn("__group", F.struct(F.lit(0).alias("__0")))
    found = percentiles(keyed, "__group", "__value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return plain.join(found, "__group", "left").select(*(F.col("__group")[c].alias(c) for c in by), "n", "mean", *(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")))


def stability(runs: DataFrame, case: str, outcome: list[str]) -> DataFrame:
    """Whether all runs of a case have one outcome."""
    return runs.groupBy(case).agg(F.count("*").alias("n_runs"), F.count_distinct(F.struct(*outcome)).alias("n_outcomes")).withColumn("stable", F.col("n_outcomes") == 1)


def ablation(tagged: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """tagged: strategy, query_id, doc_id, rank. One row a strategy."""
    strategies = tagged.select("strategy").distinct()
    wanted = relevant.select("query_id", "doc_id").distinct().join(F.broadcast(strategies))  # a row a strategy
    hits = wanted.join(tagged, ["strategy", "query_id", "doc_id"], "left")
    each = hits.groupBy("strategy", "query_id").agg(F.min("rank").alias("first"), *(F.try_divide(F.count_if(F.col("rank") <= k), F.count("*")).alias(f"r{k}") for k in depths))
    return each.groupBy("strategy").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(f"r{k}") * 100, 2).alias(f"recall_{k}") for k in depths), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg((F.coalesce(F.col("first"), F.lit(0)) == 1).cast("double")) * 100, 2).alias("top1_pct"))


def rank_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """before, after: keys and target_rank. Adds change: improved, unchanged or lower."""
    j = before.select(*keys, F.col("target_rank").alias("rank_before")).join(after.select(*keys, F.col("target_rank").alias("rank_after")), keys)
    return j.withColumn("change", F.when(F.col("rank_after") < F.col("rank_before"), "improved").when(F.col("rank_after") > F.col("rank_before"), "lower").otherwise("unchanged"))


def accuracy_verdict(pct: Column) -> Column:
    return F.when(pct >= 85, "STRONG").when(pct >= 75, "ACCEPTABLE").otherwise("NEEDS_WORK")


def ship_verdict(baseline: Column, candidate: Column, gain: float = 5.0) -> Column:
    """On recall in percent: ship only above the gain."""
    return F.when(candidate - baseline > gain, "SHIP").otherwise("KEEP_BASELINE")


def response_metadata(results: DataFrame, by: str = "conv_id") -> DataFrame:
    """retrieved, scored and abstained (all the rest, errors too) for each conversation."""
    n, scored = F.count("*"), F.count_if(F.col("status") == "scored")
    return results.groupBy(by).agg(n.alias("n_retrieved"), scored.alias("n_scored"), (n - scored).alias("n_abstained"))


def component_means(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean time of each component of a run, to two places."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean_ms"))
