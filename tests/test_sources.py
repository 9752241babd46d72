"""Readers, the vector store, the stream and substring pairs on whole and odd inputs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.operators import evaluation as ev
from lumenfold.operators import substrings
from lumenfold.sources import files
from lumenfold.sources.vectors import VectorStore

NAMES = schemas.CATALOG.fieldNames()


def entries(spark, n=51):
    text = ["plain", "", None, " led and trailed ", 'quo"ted, "twice"', "two\nlines", "café 中"]
    rows = [tuple(f"FACET_{k:03d}" if c == "facet_id" else k % 2 == 0 if c == "conversation_observable" else text[(k + i) % 7] for i, c in enumerate(NAMES)) for k in range(n)]
    return spark.createDataFrame(rows, schemas.CATALOG), {tuple(r) for r in rows}


@pytest.mark.parametrize("one_file", [True, False])
def test_catalog_round_trips_every_row(spark, tmp_path, one_file):
    rows, want = entries(spark)
    files.write_catalog(rows.repartition(3), str(tmp_path), one_file)
    for name in ("catalog.parquet", "catalog_csv", "catalog_json", "catalog_json/*"):
        got = files.read_catalog(spark, str(tmp_path / name))
        same = {tuple(v or None if isinstance(v, str) else v for v in r) for r in want} if "csv" in name else want  # CSV has no empty text
        assert got.count() == 51 and {tuple(r) for r in got.collect()} == same, name


def test_json_shapes_in_one_folder(spark, tmp_path):
    at = tmp_path / "odd names_json"
    at.mkdir()
    rec = lambda k: {"facet_id": f"F{k}", "raw_facet": "a\nb"}
    (at / "array file.json").write_text(json.dumps([rec(1), rec(2)]))
    (at / "pretty.json").write_text(json.dumps([rec(3), rec(4)], indent=2))
    (at / "lines%20x.json").write_text("\n\n" + "\n".join(json.dumps(rec(k)) for k in (5, 6, 7)) + "\n")
    (at / "one.json").write_text(json.dumps(rec(8), indent=1))
    (at / "none.json").write_text("")
    got = files.read_catalog(spark, str(at))
    assert sorted(r.facet_id for r in got.collect()) == [f"F{k}" for k in range(1, 9)] and got.columns == NAMES
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(tmp_path / "unnamed"))
    assert files.read_catalog(spark, str(at / "one.json"), "json").count() == 1


def test_raw_catalog_picks_the_encoding_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Facets\ncafé\nNA\n".encode())
    (tmp_path / "b.csv").write_bytes("facets\nnaïve–two\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"Facets\nna\xefve \x81\n")
    rows = files.read_raw_catalog(spark, str(tmp_path))
    assert sorted(r.raw_facet or "" for r in rows.collect()) == ["", "café", "naïve \x81", "naïve–two"]
    assert rows.select("pos").distinct().count() == 4


def test_vector_store(spark, tmp_path):
    store, at = VectorStore(spark, str(tmp_path / "v")), str(tmp_path / "v")
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "doc_id long, text string")
    have, rest = files.embeddings(spark, at, docs)
    assert (have.count(), rest.count()) == (0, 3) and store.read() is None and store.compact() == 0
    vectors = docs.withColumn("text_hash", F.sha2("text", 256)).withColumn("vector", F.array(F.col("doc_id").cast("float")))
    assert [files.write_embeddings(vectors, at) for _ in range(2)] == [1, 2]  # two writes of a text give one row
    have, rest = files.embeddings(spark, at, docs)
    assert sorted(r.doc_id for r in have.collect()) == [1, 2] and rest.count() == 1
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 2, "two, edited").otherwise(F.col("text")))
    have, rest = files.embeddings(spark, at, edited)
    assert [r.doc_id for r in have.collect()] == [1] and [r.doc_id for r in rest.filter("doc_id IS NOT NULL").collect()] == [2]
    reader = store.read()  # planned before the write that follows
    files.write_embeddings(rest.withColumn("vector", F.array(F.lit(9.0))), at)
    assert {r.doc_id: list(r.vector) for r in reader.collect()} == {1: [1.0], 2: [2.0]}
    assert {r.doc_id: list(r.vector) for r in store.read().collect()} == {1: [1.0], 2: [9.0]}
    store.delete(docs.filter("doc_id = 1").select("doc_id"))
    files.write_embeddings(vectors, at, "other")
    assert [r.doc_id for r in store.read().collect()] == [2] and store.read("other").count() == 2
    before = {r.doc_id for r in store.read().collect()}
    assert store.compact() == 6 and len(store.manifest()["folders"]) == 1
    assert {r.doc_id for r in store.read().collect()} == before and store.read("other").count() == 2 and store.read(version=1).count() == 2
    assert store.vacuum() == [] and len(store.vacuum(grace_s=-5)) == 5 and store.read("other").count() == 2
    with pytest.raises(ValueError):
        store.delete(spark.createDataFrame([("x",)], "doc_id string"))


def test_only_one_writer_makes_a_version(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    made = {"version": 1, "folders": [], "id": "bigint"}
    assert store._commit(made) and not store._commit(made | {"folders": ["x"]}) and store.manifest()["folders"] == []


def test_stream_rejects_and_leaves_no_scratch(spark, tmp_path):
    from lumenfold.session import shared_dir
    from lumenfold.streaming import evaluate as streaming

    catalog = spark.createDataFrame([(0, "FACET_001", "Risk", "Risk", "conversational_trait", True, "low", "about risk", None, None, "valid")], "pos long, facet_id string, raw_facet string, normalized_facet string, facet_type string, conversation_observable boolean, sensitivity string, scoring_definition string, scoring_anchors string, abstention_reason string, quality_flag string")
    out, scratch = str(tmp_path / "out"), f"{shared_dir(spark)}/lumenfold"
    assert streaming.committed(spark, out) is None
    for k in range(10):
        spark.createDataFrame([(3 * k, "a risk"), (3 * k + 1, "  "), (3 * k + 2, "x" * 20_000), (-k - 1, None)], "conv_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))  # a file a batch
    before = len(os.listdir(scratch)) if os.path.isdir(scratch) else 0
    query = streaming.start(stream, catalog, out, str(tmp_path / "cp"), 1)
    query.awaitTermination()
    assert len(os.listdir(scratch)) <= before + 2  # the catalog and its index, not a table a batch
    results, rejected = (streaming.committed(spark, out, kind) for kind in (streaming.RESULTS, streaming.REJECTED))
    assert results.select("batch").distinct().count() == 10
    assert sorted(r.conv_id for r in results.collect()) == [3 * k for k in range(10)]
    assert {(r.conv_id, r.error) for r in rejected.collect()} == {(c, e) for k in range(10) for c, e in ((3 * k + 1, "blank"), (3 * k + 2, "too long"), (-k - 1, "blank"))}
    os.remove(os.path.join(out, streaming.COMMITS, "9"))  # as if the batch had been stopped between its sinks
    assert streaming.committed(spark, out).select("batch").distinct().count() == 9


def test_substring_pairs_equal_the_cross_join(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "xabcy", "bca", "ünder 中文字", "中文", "aaaa", None, "the cat", "cat the"]
    t = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "id int, text string")
    w = spark.createDataFrame([(k, s) for k, s in enumerate([*texts, "nowhere", "cat", "文", "e c", "bc", "bc"])], "w int, want string")
    for gram in (1, 2, 3, 5):
        got = sorted((r.id, r.w) for r in substrings.substring_pairs(t, "text", w, "want", gram).collect())
        assert got == sorted((r.id, r.w) for r in t.crossJoin(w).filter("length(want) > 0 AND contains(text, want)").collect())
    plan = substrings.substring_pairs(t, "text", w, "want")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_name_resolution_without_nested_loop(spark):
    catalog = spark.createDataFrame([(0, "F0", "Risk taking", "Risk taking"), (1, "F1", "Open", "Openness to risk"), (2, "F2", "x", "Risk")], "pos long, facet_id string, raw_facet string, normalized_facet string")
    names = spark.createDataFrame([(1, "risk"), (2, "ness to"), (3, "none such"), (4, "Open"), (5, "nick"), (6, ""), (7, "to")], "name_id long, name string")
    got = ev.resolve_names(names, catalog, spark.createDataFrame([("Nick:", "Openness to risk")], "alias string, target string"))
    assert {r.name_id: (r.facet_id, r.matched_by) for r in got.collect()} == {1: ("F2", "lower"), 2: ("F1", "contains"), 3: (None, "none"), 4: ("F1", "raw"), 5: ("F1", "alias"), 6: (None, "none"), 7: ("F1", "contains")}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
