"""The corpus pipeline's stages and the registered queries on small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from lumenfold.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    n = df.count()
    whole = {"op8_url_filter": "pages"}.get(name, "documents")
    if name not in ("op9_ann", "op5_mixing", "op11_phrases"):
        assert n == spark.read.parquet(f"{SF}/{whole}.parquet").count()
    assert n > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = c.execute(ORACLES[name]())
    names = [d[0] for d in found.description]
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert sorted(names) == sorted(df.columns) and text(df.select(*names).collect()) == text(found.fetchall())


def test_stages_keep_columns_and_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, logit string, fp long, ids string, `odd.name` string"
    rows = [(i, t, "en", "s", None, 1.0, "x", 2, "y", "z") for i, t in enumerate([None, "", "the cat and the dog in the house", "the cat and the dog in the house", "12 34", "one more of the kind here " * 500])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        counts.append(sorted(r.doc_id for r in docs.collect()))
    assert counts[0] == [0, 1, 2, 3, 4, 5] and counts[1] == [2, 3, 5] and counts[2] == [2, 5] and set(counts[3]) == {2, 5} and set(counts[4]) == {2, 5}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_mixture_files_hold_the_permutation(spark, tmp_path):
    from glob import glob

    import pyarrow.parquet as pq

    from lumenfold.llm import mixing

    rows = [(i, " ".join(["word"] * 300), "en", f"s{i % 2}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "out"))
    got = [(r["doc_id"], r["source"]) for f in sorted(glob(str(tmp_path / "out" / "part-*"))) for r in pq.read_table(f).to_pylist()]
    mixed = mixing.mix(docs, limit=1.5).collect()
    for s in ("s0", "s1"):
        want = [r.doc_id for r in sorted(mixed, key=lambda r: (r["__at"], r["__block"], r["__place"])) if r.source == s]
        assert want and [i for i, x in got if x == s] == want
