"""End to end: conversations against a catalog, one lazy plan for all conversations at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import catalog as cat
from lumenfold.operators import evaluation, ledger, measures, retrieval, scoring
from lumenfold.session import stored

STRATEGIES = ("bm25", "terms", "rrf", "rrf_pooled", "tiered")


def fold(turns: DataFrame) -> DataFrame:
    """conv_id, text: the turns of a conversation in order, a line each; null turns are left out."""
    said = turns.filter(F.col("text").isNotNull())
    return said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))


def split_inputs(conversations: DataFrame, max_chars: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, with text trimmed; rejected, with error)."""
    judged = conversations.withColumn("error", text.input_error(F.col("text"), max_chars))
    return judged.filter("error IS NULL").drop("error").withColumn("text", text.strip(F.col("text"))), judged.filter("error IS NOT NULL")


def split_requests(requests: DataFrame, max_top_k: int = 50, default_top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """requests: conv_id, text, top_k (null: the default). (accepted, with text trimmed; rejected, with error).

    A search takes texts of any length; one that is blank, or asks for no or over max_top_k entries, is rejected."""
    asked = requests.withColumn("top_k", F.coalesce("top_k", F.lit(default_top_k)))
    bad_k = F.when(~F.col("top_k").between(1, max_top_k), "top_k out of range")
    judged = asked.withColumn("error", F.coalesce(text.input_error(F.col("text"), None), bad_k))
    return judged.filter("error IS NULL").drop("error").withColumn("text", text.strip(F.col("text"))), judged.filter("error IS NOT NULL")


def retrieve_requests(requests: DataFrame, catalog: DataFrame, strategy: str = "bm25", max_top_k: int = 50) -> DataFrame:
    """query_id, doc_id, rank of each accepted request, as many as it asks for."""
    accepted = split_requests(requests, max_top_k)[0]
    found = retrieve(accepted, catalog, max_top_k, strategy)
    return found.join(accepted.select(F.col("conv_id").alias("query_id"), "top_k"), "query_id").filter("rank <= top_k").select("query_id", "doc_id", "rank")


def documents_of(catalog: DataFrame) -> DataFrame:
    """The observable entries as documents, in catalog order."""
    entries = cat.observable(catalog)
    return entries.select(F.col("facet_id").alias("doc_id"), F.col("pos").alias("doc_pos"), text.lexical_text(F.col("normalized_facet"), F.col("facet_type"), F.col("scoring_definition")).alias("text"))


def indexed(catalog: DataFrame) -> DataFrame:
    """The entries with their terms, stored: what several calls of retrieve or evaluate can share."""
    docs = documents_of(catalog)
    return stored(docs.join(retrieval.lexical_terms(docs).drop("doc_pos"), "doc_id"))


def retrieve(conversations: DataFrame, catalog: DataFrame, top_k: int = 10, strategy: str = "bm25", pool: int = 50, index: DataFrame | None = None) -> DataFrame:
    """query_id (the conversation's), doc_id (the entry's), rank. index: what ``indexed`` made of the catalog."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    docs, queries = index if index is not None else documents_of(catalog), conversations.select(F.col("conv_id").alias("query_id"), "text")
    if strategy == "bm25":
        return retrieval.bm25_many(docs, queries, top_k)
    if strategy == "terms":
        return retrieval.term_cosine(docs, queries, top_k)
    depth = pool if strategy == "rrf_pooled" else 60 + 2 * top_k  # no entry outside both lists' first 59 + 2 k can be among the best k
    lists = [retrieval.bm25_many(docs, queries, depth), retrieval.term_cosine(docs, queries, depth)]
    return retrieval.tiered_union(lists, top_k, top_k) if strategy == "tiered" else retrieval.rrf(lists, top_k)


def entries_of(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """found (stored: conv_id, facet_id, rank) with the catalog's columns. Most conversations find the same few entries, so
    only those that any found go into the join, as a small table where they are few, and no entry's rows are one task."""
    return found.join(catalog.join(found.select("facet_id").distinct(), "facet_id", "left_semi"), "facet_id")


def routed(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to score, to abstain from): only a flag that is false abstains, a null one doesn't."""
    hidden = F.coalesce(~F.col("conversation_observable"), F.lit(False))
    return candidates.filter(~hidden), candidates.filter(hidden)


def evaluate(conversations: DataFrame, catalog: DataFrame, top_k: int = 10, batch_size: int = 10, backend: Callable[[str, str], str] | None = None, facets: DataFrame | None = None, strategy: str = "bm25", keep_outputs: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None, answers: str | None = None) -> DataFrame:
    """conv_id, rank, facet_id, facet, status, score, confidence, evidence, reason.

    facets (conv_id, facet_id) replaces retrieval for the conversations that it names. backend None is the rule backend,
    pure columns; else it is called once for each conversation and batch, and keep_outputs may write its output first; answers is the folder
    of a ledger (``operators.ledger``) that keeps what the backend said, so that no prompt in it is asked again.
    """
    asking = conversations if facets is None else conversations.join(facets.select("conv_id").distinct(), "conv_id", "left_anti")
    found = retrieve(asking, catalog, top_k, strategy, index=index).select(F.col("query_id").alias("conv_id"), F.col("doc_id").alias("facet_id"), F.col("rank").cast("int").alias("rank"))
    if facets is not None:
        given = facets.join(catalog.select("facet_id", "pos"), "facet_id")
        given = retrieval.ranked(given, [F.col("pos")], by="conv_id").select("conv_id", "facet_id", F.col("rank").cast("int").alias("rank"))
        found = found.unionByName(given)
    talk = conversations.select("conv_id", scoring.cues(F.col("text")).alias("cues")) if backend is None else conversations.select("conv_id", "text")
    candidates = entries_of(stored(found), catalog.drop("pos")).join(talk, "conv_id")
    score, abstain = routed(candidates)
    hidden = abstain.select("conv_id", "rank", scoring.unobservable_result(F.col("facet_id"), F.col("normalized_facet"), F.col("abstention_reason")).alias("r")).select("conv_id", "rank", "r.*")
    if backend is None:
        scored = score.select("conv_id", "rank", scoring.rule_result(F.col("facet_id"), F.col("normalized_facet"), F.col("cues")).alias("r")).select("conv_id", "rank", "r.*")
    else:
        batched = scoring.batches(score, batch_size)
        asked = scoring.prompts(batched)
        outputs = ledger.complete(asked, backend, answers) if answers else scoring.complete(asked, backend)
        scored = scoring.parse(keep_outputs(outputs) if keep_outputs else outputs, batched.withColumnRenamed("normalized_facet", "facet"))
    return scored.select("conv_id", "rank", *scoring.RESULT_COLUMNS).unionByName(hidden.select("conv_id", "rank", *scoring.RESULT_COLUMNS))


def measured(run: measures.Run, conversations: DataFrame, catalog: DataFrame, top_k: int = 10, max_chars: int = 10_000, **options) -> tuple[DataFrame, DataFrame]:
    """(results, rejected) of conversations, stored, with the counts of ``evaluation.response_metadata`` over all of them and
    the time of each step in run. options: those of ``evaluate``."""
    accepted, rejected = split_inputs(conversations, max_chars)
    accepted, rejected = run.step("accepted", accepted), run.step("rejected", rejected)
    scored = F.col("status") == "scored"
    return run.step("results", evaluate(accepted, catalog, top_k, **options), n_scored=F.count_if(scored), n_abstained=F.count_if(~scored)), rejected


def responses(results: DataFrame) -> DataFrame:
    """One row a conversation: how many were retrieved, and the scored and the abstained results in rank order."""
    row = F.struct("rank", *scoring.RESULT_COLUMNS)
    some = lambda c: F.array_sort(F.filter(F.collect_list(F.when(c, row)), lambda x: x.isNotNull()))
    return results.groupBy("conv_id").agg(F.count("*").cast("int").alias("total_candidates_retrieved"), some(F.col("status") == "scored").alias("evaluated_results"), some(F.col("status") != "scored").alias("abstained_results"))


def benchmark(annotations: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """annotations: conv_id, facet_id, expected_status, expected_score. The metric tables of a run."""
    predictions = results.select("conv_id", "facet_id", "rank", F.col("status").alias("predicted_status"), F.col("score").alias("predicted_score"))
    rows = evaluation.with_predictions(annotations, predictions, ["conv_id", "facet_id"], "rank")
    return {
        "rows": rows, "accuracy": evaluation.status_accuracy(rows), "abstention": evaluation.abstention_prf(rows), "error": evaluation.score_error(rows),
        "false_scoring": evaluation.false_scoring(rows), "confusion": evaluation.confusion_matrix(rows),
    }
