"""Ranking, scoring and metrics on small fixtures."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import evaluation as ev
from lumenfold.operators import retrieval as ret
from lumenfold.operators import scoring as sc
from lumenfold.plans import evaluate as plan
from lumenfold.sources import files


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", 0, "risk taking trait"), ("b", 1, "calm mind"), ("c", 2, "risk of falling"), ("d", 3, "other")], "doc_id string, doc_pos long, text string")


def test_bm25_orders_zero_scores_by_place(spark, docs):
    q = spark.createDataFrame([(1, "risk taking"), (2, "zzz"), (3, None)], "query_id int, text string")
    top = {}
    for r in ret.bm25_top(docs, q, 3).orderBy("query_id", "rank").collect():
        top.setdefault(r.query_id, []).append(r.doc_id)
    assert top == {1: ["a", "c", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"]}
    every = ret.bm25_all(docs, q).filter("query_id = 1").orderBy("rank").collect()
    assert [r.doc_id for r in every] == ["a", "c", "b", "d"]


def test_fusion_and_tiers(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    assert [r.doc_id for r in ret.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.doc_id for r in ret.tiered_union([a, b], 2, 3).orderBy("rank").collect()] == ["x", "y", "z"]
    target = spark.createDataFrame([(1, "y"), (1, "q")], "query_id int, doc_id string")
    assert {r.doc_id: r.target_rank for r in ret.target_rank(a, target).collect()} == {"y": 2, "q": 999}


def test_complete_fusion_and_containment_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, i, " ".join(rng.choice(vocab, rng.integers(1, 12))) if i % 9 else "zzz", rng.standard_normal(4).tolist() if i % 4 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_pos long, text string, vector array<double>")
    asked = [(1, "w1 w2 w3", [1.0, 0.0, 0.0, 0.0]), (2, "nothing", [0.0, 1.0, 0.0, 0.0]), (3, "w5 w6", None), (4, "w7", [0.0, 0.0, 1.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, text string, vector array<double>")
    got = [(r.query_id, r.doc_id, r.rank) for r in ret.rrf_complete(docs.drop("vector"), docs, queries, 7).orderBy("query_id", "rank").collect()]
    want = [(r.query_id, r.doc_id, r.rank) for r in ret.rrf([ret.bm25_all(docs, queries), ret.dense_top(docs, queries, None)], 7).orderBy("query_id", "rank").collect()]
    assert got == want and len(got) == 28
    more = spark.createDataFrame([(1, " ".join(rows[5][2].split()[:3])), (2, rows[7][2]), (3, "1 w"), (4, None), (5, "w")], "query_id long, text string")
    held = {(r.query_id, r.doc_id) for r in ret.containing(docs, ret.index(docs), more).collect()}
    assert held == {(q, r[0]) for q, t in more.collect() if t is not None for r in rows if t in r[2]}


def test_dense_zero_vectors(spark):
    d = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 2, None)], "doc_id long, doc_pos long, vector array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, vector array<float>")
    got = {(r.query_id, r.doc_id): r.score for r in ret.dense_top(d, q, 5).collect()}
    assert got == {(7, 1): 1.0, (7, 2): 0.0, (8, 1): 0.0, (8, 2): 0.0}


def test_parser_keeps_first_valid_and_fills(spark):
    raw = '```json [{"facet_id":"F1","facet":"n","status":"scored","score":4.5,"confidence":0.9,"evidence":"\'q\'","reason":"r"},] ```'
    outputs = spark.createDataFrame([(1, 0, raw, None), (2, 0, None, "TimeoutError: x")], "conv_id int, batch int, raw_output string, error string")
    wanted = spark.createDataFrame([(1, 0, "F1", "n", 1), (1, 0, "F2", "m", 2), (2, 0, "F1", "n", 1)], "conv_id int, batch int, facet_id string, facet string, rank int")
    got = [(r.conv_id, r.facet_id, r.status, r.score, r.confidence, r.evidence) for r in sc.parse(outputs, wanted).orderBy("conv_id", "rank").collect()]
    assert got == [(1, "F1", "scored", 4, 0.9, "q"), (1, "F2", "insufficient_evidence", None, 0.85, None), (2, "F1", "inference_error", None, 0.0, None)]


def test_harness_states(spark):
    rows = ["", '[{"facet_id": "a"}]', '{"results": [1]}', '{"score": 1}', '[{"facet_id": "a"}, {"facet_id": "b"}, {"facet_id": "c', "x", '{"other": 1}']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(sc.harness_state(F.col("x"))).collect()]
    assert got == ["empty_output", "valid_array", "valid_array", "single_object", "truncated_recovery", "parse_error", "parse_error"]


def test_harness_reads_the_first_list_of_an_object(spark):
    rows = ['{"z": [7, {"facet_id": "a", "score": null}], "b": [2]}', '{"x": {"y": [1]}, "d": "]"}', '[1, {"facet": " n ", "score": "3", "confidence": 0.5}, null]', '{"status": "x", "k": {"l": []}} ]']
    read = spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", sc.harness_read(F.col("x")).alias("r"))
    got = [(r.state, [tuple(i) for i in r.items_]) for r in read.orderBy("i").select("r.state", sc.harness_items(F.col("r.items")).alias("items_")).collect()]
    assert got[0] == ("wrapped_object", [("a", 0.0, "abstained", "medium", "")])
    assert got[1] == ("parse_error", [])
    assert got[2] == ("valid_array", [("n", 3.0, "abstained", "0.5", "")])
    assert got[3] == ("single_object", [("", 0.0, "abstained", "medium", "")])


def test_model_vectors_and_semantic_list(spark):
    letters = lambda texts: [[t.count("a"), t.count("b"), 0.0] for t in texts]
    docs = spark.createDataFrame([(1, 1, "aaa"), (2, 2, "bb"), (3, 3, "ab"), (4, 4, None)], "doc_id long, doc_pos long, text string")
    asked = spark.createDataFrame([(7, "aab")], "query_id long, text string")
    found = ret.semantic_top(docs, asked, 2, "model", lambda: letters).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in found] == [(3, 0.948683), (1, 0.894427)]
    with pytest.raises(ValueError):
        ret.semantic_top(docs, asked, 2, "model")
    fused = ret.tri_fusion(ret.bm25_top(docs, asked, 4), docs, asked, asked, 4, backend="model", load=lambda: letters)
    assert [r.doc_id for r in fused.orderBy("rank").collect()][0] in (1, 3)


def test_model_scorer_reranks(spark):
    found = spark.createDataFrame([(1, 1, 1, "aa", "b"), (1, 2, 2, "aa", "aaa"), (1, 3, 3, "aa", None)], "query_id long, doc_id long, rank int, query_text string, doc_text string")
    got = ret.rerank(found, ret.model_scorer(lambda: lambda q, d: [float(x.count("a")) for x in d]), 2).orderBy("new_rank").collect()
    assert [(r.doc_id, r.reranker_score) for r in got] == [(2, 3.0), (1, 0.0)]


def test_http_backend_retries_once():
    calls = []

    def server(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "ok"}}]}).encode())

    assert sc.HttpBackend("http://host/v1/chat/completions", open_url=server, wait_s=0)("s", "u") == "ok"
    assert calls == ["http://host/v1/chat/completions"] * 2

    def missing(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 404, "no", {}, None)

    with pytest.raises(ConnectionError):
        sc.HttpBackend("http://host", open_url=missing, wait_s=0)("s", "u")


def test_failing_backend_is_inference_error(spark):
    catalog = spark.createDataFrame([(0, "FACET_001", "Risk", "Risk", "conversational_trait", True, "low", "about risk", None, None, "valid"), (1, "FACET_002", "Iron level", "Iron level", "medical_biomarker", False, "clinical_medical", "iron", None, "lab", "valid")], "pos long, facet_id string, raw_facet string, normalized_facet string, facet_type string, conversation_observable boolean, sensitivity string, scoring_definition string, scoring_anchors string, abstention_reason string, quality_flag string")
    talk = spark.createDataFrame([(1, "I took a risk, solo")], "conv_id long, text string")
    given = spark.createDataFrame([(1, "FACET_001"), (1, "FACET_002")], "conv_id long, facet_id string")

    def broken(system, user):
        raise ValueError("no")

    got = {r.facet_id: (r.status, r.score, r.confidence) for r in plan.evaluate(talk, catalog, backend=broken, facets=given).collect()}
    assert got == {"FACET_001": ("inference_error", None, 0.0), "FACET_002": ("not_observable", None, 0.99)}
    rules = {r.facet_id: (r.status, r.score) for r in plan.evaluate(talk, catalog, facets=given).collect()}
    assert rules == {"FACET_001": ("scored", 5), "FACET_002": ("not_observable", None)}
    assert plan.responses(plan.evaluate(talk, catalog)).first().total_candidates_retrieved == 1
    for strategy in plan.STRATEGIES:
        assert plan.retrieve(talk, catalog, 3, strategy).count() == 1


def test_metrics(spark):
    rows = spark.createDataFrame([("scored", "scored", 4, 4), ("scored", "scored", 5, 4), ("not_observable", "insufficient_evidence", None, None), ("not_observable", "scored", None, 3)], "expected_status string, predicted_status string, expected_score int, predicted_score int")
    a = ev.status_accuracy(rows).first()
    assert (a.n, a.strict_pct, a.lenient_pct) == (4, 50.0, 75.0)
    p = ev.abstention_prf(rows).first()
    assert (p.precision_pct, p.recall_pct, p.f1_pct) == (100.0, 50.0, 66.67)
    assert ev.score_error(rows).first().mae == 0.5
    assert ev.false_scoring(rows).first().n_false == 1
    assert ev.status_accuracy(rows.limit(0)).first().strict_pct == 0.0


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes("Facets\nRisk–taking\n644. Iron\n\nNA\n".encode("cp1252"))
    rows = files.read_raw_catalog(spark, str(path)).orderBy("pos").collect()
    assert [r.raw_facet for r in rows] == ["Risk–taking", "644. Iron", None]
    from lumenfold.operators import catalog as cat

    built = cat.build(files.read_raw_catalog(spark, str(path)))
    files.write_catalog(built, str(tmp_path / "out"))
    for name in ("catalog.parquet", "catalog_csv", "catalog_json"):
        assert (spark.read.parquet if name.endswith("parquet") else spark.read.csv if name.endswith("csv") else spark.read.json)(str(tmp_path / "out" / name)).count() >= 3
    path.write_bytes("Facets\ncaf\u00e9 a\ufffdb\n".encode())  # valid UTF-8, though a character was lost before
    assert files.read_raw_catalog(spark, str(path)).first().raw_facet == "café a\ufffdb"
    with pytest.raises(FileNotFoundError):
        files.read_raw_catalog(spark, str(tmp_path / "none.csv"))
    assert files.markdown_table(spark.createDataFrame([(1, "a|b")], "n int, s string")).splitlines()[2] == "| 1 | a\\|b |"
    (tmp_path / "ref.json").write_text('[{"conversation_id": "c", "conversation_text": "t", "category": "k", "annotations": [{"facet_id": "F", "facet": "n", "expected_status": "scored", "expected_score": 3, "human_rationale": "r"}]}]')
    assert files.annotations_of(files.read_reference_set(spark, str(tmp_path / "ref.json"))).first().expected_score == 3


def test_percentiles_over_ranges(spark):
    rows = [(g, float(v)) for g, n in (("a", 40), (None, 7), ("b", 1)) for v in [(k * k) % 11 for k in range(n)]] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    want = {r.g: tuple(round(x, 6) if x is not None else None for x in r[1:]) for r in df.groupBy("g").agg(*(F.percentile("v", q).alias(c) for c, q in shares.items())).collect()}
    got = ev.percentiles(df.select(F.struct("g").alias("k"), "v"), "k", "v", shares, rows_per_range=2)
    assert {r.k.g: tuple(round(r[c], 6) for c in shares) for r in got.collect()} == {k: v for k, v in want.items() if k != "c"}
    many = {r.g: r for r in ev.latency(df, "v", "g").collect()}
    assert set(many) == {"a", None, "b", "c"} and many["c"].n == 0 and many["c"].p50 is None and many[None].p95 == round(want[None][1], 4)
    assert ev.latency(df, "v").first().n == 48
    empty = ev.latency(df.limit(0), "v").first()
    assert (empty.n, empty.mean, empty.p99) == (0, None, None)


def test_stream(spark, tmp_path):
    from lumenfold.streaming import evaluate as streaming

    catalog = spark.createDataFrame([(0, "FACET_001", "Risk", "Risk", "conversational_trait", True, "low", "about risk", None, None, "valid")], "pos long, facet_id string, raw_facet string, normalized_facet string, facet_type string, conversation_observable boolean, sensitivity string, scoring_definition string, scoring_anchors string, abstention_reason string, quality_flag string")
    spark.createDataFrame([(1, "a risk"), (2, "calm")], "conv_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, text string").parquet(str(tmp_path / "in"))
    streaming.start(stream, catalog, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    assert streaming.committed(spark, str(tmp_path / "out")).count() == 2
