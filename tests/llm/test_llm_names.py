"""Columns that have the names that operators use themselves, and the mixture against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import common, language_id, mixing, simhash, url_filter

HIDDEN = ["__row", "__source", "__tokens", "__hash", "__epoch", "__at", "__e", "__seq", "__order", "__block", "__blocks", "__place", "__stride", "__whole", "__last", "__cut", "__budget", "__rest", "__text", "__document"]


@pytest.fixture(scope="module")
def hidden(spark):
    rows = [(k, f"some words of text {k} here", "en", f"s{k % 3}", *(f"{n}-{k}" for n in HIDDEN)) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in HIDDEN))


def test_kept_names():
    assert common.kept_names(("a", "fp", "fp_kept", "FP"), ("fp",)) == ("a", "fp_kept_kept", "fp_kept", "FP_kept_kept_kept")
    assert common.kept_names((), ("x",)) == ()


def test_mixture_keeps_every_hidden_column(hidden):
    mixed = mixing.mix(hidden, limit=1.5)
    names = common.kept_names(hidden.columns, mixing.MADE)
    assert tuple(mixed.columns) == (*names, *mixing.MADE)
    for r in mixed.collect():
        assert all(r[n] == f"{c}-{r.doc_id}" for c, n in zip(hidden.columns, names, strict=True) if c in HIDDEN)
    staged = corpus_pipeline.mix_sources(None, hidden, "")
    assert staged.columns == hidden.columns
    assert {tuple(r) for r in staged.collect()} == {tuple(r) for r in hidden.collect()}


def test_packed_stages_keep_every_hidden_column(hidden):
    packed = corpus_pipeline._packed(hidden.drop("__document", "__text"))
    model = language_id.train(hidden)
    back = corpus_pipeline._unpacked(language_id.predict(packed, model, text="__text", keep=(corpus_pipeline.ROW,)), hidden.drop("__document", "__text"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in hidden.drop("__document", "__text").collect()}


def test_kept_columns_of_any_name(spark, hidden):
    docs = hidden.select("doc_id", "text", F.col("__row").alias("fp"), F.col("__at").alias("fp_kept"), F.col("__text"))
    got = simhash.fingerprints(docs, keep=("doc_id", "fp", "fp_kept", "__text"))
    assert got.columns == ["doc_id", "fp_kept_kept", "fp_kept", "__text_kept", "fp"]
    r = got.filter("doc_id = 3").first()
    assert (r.fp_kept_kept, r.fp_kept, r["__text_kept"]) == ("__row-3", "__at-3", "__text-3")
    pages = spark.createDataFrame([(1, "https://example.net/en/x", "h", "v", "x", "r")], "page_id long, url string, host string, verdict string, x string, row string")
    r = url_filter.filter_urls(pages, keep=("page_id", "host", "verdict", "x", "row", "url")).first()
    assert (r.host_kept, r.verdict_kept, r.x, r.row, r.host, r.verdict) == ("h", "v", "x", "r", "example.net", "allow")


@pytest.mark.parametrize(("limit", "budget"), [(2.0, 900.0), (1.5, None), (4.0, 3000.0)])
def test_mixture_takes_what_its_weights_say(spark, limit, budget):
    """Each source's whole epochs take all its rows once; the rest is a run of the next epoch's permutation that ends with the row
    that reaches the source's budget."""
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 9))), f"s{min(k % 7, 2)}") for k in range(150)] + [(7, "same text", "s0")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, limit=limit, budget=budget, block_tokens=40).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    low, high = 0.0, 1.0  # the exponent, by another search: the least at which no source is over the limit
    over = lambda e: max(r for r in times(e).values()) > limit * (1 + 1e-12)

    def times(e):
        w = {s: (t / sum(tokens.values())) ** e for s, t in tokens.items()}
        w = {s: x / sum(w.values()) for s, x in w.items()}
        b = budget if budget is not None else max(tokens[s] / w[s] for s in w)
        return {s: w[s] * b / tokens[s] for s in w}

    if over(0.0):
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if over(mid) else (low, mid)
    else:
        high = 0.0
    for s, r in times(high).items():
        own = [x for x in got if x.source == s]
        whole, rest = math.floor(r + 1e-9), max(0.0, r - math.floor(r + 1e-9)) * tokens[s]
        for e in range(whole):
            assert Counter((x.doc_id, x.text) for x in own if x["__epoch"] == e) == Counter((i, t) for i, t, z in rows if z == s)
        last = sorted((x["__block"], x["__place"], len(x.text.split())) for x in own if x["__epoch"] == whole)
        assert {x["__epoch"] for x in own} <= set(range(whole + 1))
        taken = sum(n for *_, n in last)
        final = [n for b, p, n in last if (b, p) == last[-1][:2]] if last else []
        assert taken + 1e-6 >= min(rest, tokens[s]) - 1e-6 and taken - sum(final) < rest + 1e-6
