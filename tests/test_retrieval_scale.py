"""What retrieval makes beside its result, and that the result is that of all pairs."""

import numpy as np

from lumenfold.operators import retrieval as ret
from lumenfold.plans import evaluate as plan


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_alike_documents_are_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"trait {i} {'the of' if i % 3 else 'calm'} {'risk' if i % 7 == 0 else ''} text" for i in range(600)]
    docs = spark.createDataFrame([(f"d{i:04}", i, n) for i, n in enumerate(names)], "doc_id string, doc_pos long, text string")
    words = np.array(["the", "of", "calm", "risk", "text", "zzz", "17", "trait 3"])
    asked = [(q, " ".join(rng.choice(words, 3))) for q in range(40)] + [(40, None), (41, "text"), (42, "nothing")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    made = []
    monkeypatch.setattr(ret, "stored", lambda df, real=ret.stored: made.append(real(df)) or made[-1])
    found = rows_of(ret.bm25_many(docs, queries, 5))
    members = next(t for t in made if "own" in t.columns)
    assert members.count() < 200  # of 600 documents that all share a term with some query
    assert found == rows_of(ret.bm25_all(docs, queries).filter("rank <= 5"))


def test_conversations_with_given_entries_are_not_searched(spark, monkeypatch):
    catalog = spark.createDataFrame([(1, "F1", "risk", "conversational_trait", True, "d", None, None)], "pos long, facet_id string, normalized_facet string, facet_type string, conversation_observable boolean, scoring_definition string, scoring_anchors string, abstention_reason string")
    talk = spark.createDataFrame([(1, "risk"), (2, "risk")], "conv_id long, text string")
    given = spark.createDataFrame([(1, "F1")], "conv_id long, facet_id string")
    searched = []
    monkeypatch.setattr(plan, "retrieve", lambda conversations, *a, real=plan.retrieve, **k: searched.append(conversations.count()) or real(conversations, *a, **k))
    assert sorted(r.conv_id for r in plan.evaluate(talk, catalog, facets=given).collect()) == [1, 2]
    assert searched == [1]


def test_equal_documents_score_the_same_to_the_last_bit(spark):
    """Sums in any order put equal texts on both sides of a rounding, which orders them wrongly."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 60)) for _ in range(30)]
    rows = [(j * 1000 + i, j * 1000 + i, t) for j in range(40) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_pos long, text string").repartition(7)
    queries = spark.createDataFrame([(q, texts[q]) for q in range(30)], "query_id long, text string")
    scores = ret.Lexical(docs, queries).scores().toPandas()
    scores["kind"] = scores.doc_id % 1000
    assert len(scores) == 30 * 1200 and (scores.groupby(["query_id", "kind"]).score.nunique() == 1).all()


def test_what_leaves_a_task_does_not_grow_with_the_documents(spark):
    docs = spark.createDataFrame([(i, i, f"the same {i % 50} words") for i in range(3000)], "doc_id long, doc_pos long, text string").repartition(4).cache()
    queries = spark.createDataFrame([(q, f"the {q}") for q in range(60)], "query_id long, text string")
    lexical = ret.Lexical(ret.index(docs), queries)
    assert lexical.scores(3).count() <= 60 * 3 * lexical.docs.rdd.getNumPartitions()
    wanted = spark.createDataFrame([(7, 7), (7, 2999), (59, 0)], "query_id long, doc_id long")
    every = {(r.query_id, r.doc_id): r["rank"] for r in ret.bm25_all(docs, queries).collect()}
    assert {(r.query_id, r.doc_id): r["rank"] for r in lexical.ranks(wanted).collect()} == {p: every[p] for p in ((7, 7), (7, 2999), (59, 0))}


def test_outputs_are_repaired_once_a_text(spark):
    """Each pattern of the repair stands once in the plan, not once for each use of the repaired text."""
    from lumenfold.operators import scoring as sc

    outputs = spark.createDataFrame([(1, 0, '```json [{"facet_id":"F1","facet":"n","status":"scored","score":4,"confidence":0.9,"evidence":"q","reason":"r"},] ```')], "conv_id long, batch int, raw_output string")
    read = outputs.select(sc.items(outputs["raw_output"]).alias("i"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json") <= 2 and plan.count("```(?:json)?") <= 2
    assert [x["facet_id"] for x in read.first()["i"]] == ["F1"]


def test_term_cosine_streams_the_documents(spark):
    """Equal to plain vectors, no pair without a shared term, and nothing of the pairs leaves a task but its best."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 30, rng.integers(1, 9))) for _ in range(200)] + ["", None, "zzz"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, doc_pos long, text string")
    asked = [(0, "w1 w1 w2"), (1, "zzz w3 unknown"), (2, "unknown"), (3, None), (4, "zzz")]
    queries = spark.createDataFrame(asked, "query_id long, text string")

    def bag(t, inverse):
        w = (t or "").split()
        w = w + [f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)] if inverse else w
        return {x: w.count(x) for x in w}

    for inverse in (False, True):
        bags = [bag(t, inverse) for t in texts]
        df = {x: sum(x in b for b in bags) for b in bags for x in b}
        scale = {x: float(np.log((1 + len(texts)) / (1 + n)) + 1) if inverse else 1.0 for x, n in df.items()}
        unit = lambda b: {x: c * scale[x] / np.sqrt(sum((k * scale[y]) ** 2 for y, k in b.items() if y in scale)) for x, c in b.items() if x in scale}  # noqa: B023, E731
        want = []
        for q, t in asked:
            v = unit(bag(t, inverse))
            s = sorted((-round(sum(w * d.get(x, 0) for x, w in v.items()), 9), i) for i, d in enumerate(map(unit, bags)) if any(x in d for x in v))
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:4])]
        found = rows_of(ret.term_cosine(docs, queries, 4, inverse))
        assert [x[:3] for x in found] == [x[:3] for x in want] and np.allclose([x[3] for x in found], [x[3] for x in want], atol=2e-9)
        assert ret.Terms(docs, inverse).docs.columns == ["doc_id", "doc_pos", "terms", "norm"]
