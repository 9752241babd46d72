"""The kept index against the plain lexical list, with blocks counted."""

from __future__ import annotations

import time

import numpy as np
import pytest

from lumenfold.operators import postings, retrieval


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("ranges", "first", "k"), [(256, 3, 5), (4, 1, 3), (2, 2, 7), (8, 1, 1)])
def test_search_equals_the_plain_list(spark, monkeypatch, ranges, first, k):
    monkeypatch.setattr(postings, "RANGE", ranges)
    monkeypatch.setattr(postings, "FIRST", first)
    rng = np.random.default_rng(ranges)
    vocab = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    rows = [(i, 3 * i, " ".join(rng.choice(vocab, int(rng.integers(0, 40)), p=weight / weight.sum()).tolist())) for i in range(90)]
    rows += [(100, 1000, None), (101, 1001, ""), (102, 7, "w1 w2 w3"), (103, 8, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, doc_pos long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "w40 w50"), (2, "w1 w2 w3 w4 w59"), (3, "unknown"), (4, None), (5, "w0"), (6, " ".join(vocab[::3]))], "query_id long, text string")
    index = postings.build(docs)
    for floor in (0.01, None):
        assert rows_of(postings.search(index, queries, k, floor=floor).found) == rows_of(retrieval.bm25_top(docs, queries, k, floor=floor))
    assert rows_of(retrieval.bm25_top(postings.opened(spark, index.path), queries, k)) == rows_of(retrieval.bm25_top(docs, queries, k))  # opened again, for another search


def test_blocks_are_skipped(spark, monkeypatch):
    """A rare term beside frequent ones: only ranges that can reach the threshold are unpacked."""
    monkeypatch.setattr(postings, "RANGE", 8)
    monkeypatch.setattr(postings, "FIRST", 1)
    rows = [(i, i, "the of and " + " ".join(f"x{i}y{j}" for j in range(i % 50)) + (" needle hay" if i in (3, 4, 250) else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_pos long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "the needle hay of"), (2, "and needle")], "query_id long, text string")
    found = postings.search(postings.build(docs), queries, 2)
    assert rows_of(found.found) == rows_of(retrieval.bm25_top(docs, queries, 2))
    total, read = found.total.first().blocks, found.read.first().blocks
    assert total > 150 and read < total / 3


def test_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id long, doc_pos long, text string")
    queries = spark.createDataFrame([(1, "word")], "query_id long, text string")
    found = postings.search(postings.build(docs), queries, 3)
    assert found.found.count() == 0 and found.total.first().blocks == 0 and found.read.first().blocks == 0


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    def shuffled():
        time.sleep(1)  # the status store lags behind
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, i, " ".join(rng.choice(vocab, int(rng.integers(4, 30))).tolist())) for i in range(3000)], "doc_id long, doc_pos long, text string").coalesce(2)
    queries = spark.createDataFrame([(q, " ".join(rng.choice(vocab, 8).tolist())) for q in range(60)], "query_id long, text string")
    index = postings.build(docs)
    before = shuffled()
    assert postings.search(index, queries, 3).found.count() == 180
    assert shuffled() - before < 600_000  # 180,000 pairs share a term
