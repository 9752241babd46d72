"""Every operator as a query over the tables of a folder, each with the SQL that states its result independently."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import catalog as cat
from lumenfold.operators import evaluation as ev
from lumenfold.operators import measures, postings
from lumenfold.operators import retrieval as ret
from lumenfold.operators import scoring as sc
from lumenfold.plans import evaluate as plan
from lumenfold.plans import sql as S
from lumenfold.session import shared_dir, spread, stored
from lumenfold.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.index = spark, sf_dir, None

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        return self.spark.sql(S.RAW_PART.replace("FROM part", "FROM {part}"), part=self.part)

    def catalog(self) -> DataFrame:
        return cat.build(self.raw())

    def kept_catalog(self) -> DataFrame:
        return stored(self.catalog())

    def accepted(self) -> DataFrame:
        return stored(plan.split_inputs(self.folded())[0])

    def folded(self) -> DataFrame:
        return plan.fold(self.conversations)

    def corpus(self) -> DataFrame:
        """All documents, in the order of their ids."""
        return self.documents.select("doc_id", F.col("doc_id").alias("doc_pos"), "text")

    def indexed(self) -> DataFrame:
        """The terms of all documents, tokenized once a query."""
        if self.index is None:
            self.index = ret.index(self.corpus())
        return self.index

    def dense(self) -> DataFrame:
        """The vectors of those documents that have one."""
        return self.vectors().join(self.documents.select("doc_id"), "doc_id", "left_semi")

    def asked(self) -> DataFrame:
        vectors = self.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")

    def judged(self) -> DataFrame:
        """Labelled documents as expected and predicted statuses and scores."""
        annotations = self.labels.select("doc_id", F.expr(EXPECTED).alias("expected_status"), F.expr(EXPECTED_SCORE).alias("expected_score"))
        predictions = self.documents.select("doc_id", F.expr(PREDICTED).alias("predicted_status"), F.expr(PREDICTED_SCORE).alias("predicted_score"))
        return ev.with_predictions(annotations, predictions, ["doc_id"], "doc_id")

    def ranks(self) -> DataFrame:
        """Same-label neighbours of every query vector: query_id, doc_id of relevant ones."""
        e = self.embeddings
        q = self.asked().select("query_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
        return q.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id")

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("doc_pos"), F.col("embedding").alias("vector"))


EXPECTED = "CASE WHEN toxic = 1 THEN 'not_observable' WHEN quality = 1 THEN 'scored' ELSE 'insufficient_evidence' END"
EXPECTED_SCORE = "CASE WHEN toxic = 0 AND quality = 1 THEN CAST(1 + doc_id % 5 AS INT) END"
PREDICTED = "CASE n_chars % 7 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN 'not_observable' WHEN 2 THEN NULL ELSE 'scored' END"
PREDICTED_SCORE = "CASE WHEN n_chars % 7 >= 3 THEN CAST(1 + n_chars % 5 AS INT) END"
JUDGED = f"""judged AS (SELECT l.doc_id, l.expected_status, l.expected_score, coalesce(p.ps, 'insufficient_evidence') AS predicted_status, p.pc AS predicted_score FROM
 (SELECT doc_id, {EXPECTED} AS expected_status, {EXPECTED_SCORE} AS expected_score FROM labels) l LEFT JOIN (SELECT doc_id, {PREDICTED} AS ps, {PREDICTED_SCORE} AS pc FROM documents) p USING (doc_id))"""
CORPUS = """corpus AS MATERIALIZED (SELECT d.doc_id AS doc, d.doc_id AS pos, d.text, e.embedding::DOUBLE[] AS v FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
asked AS MATERIALIZED (SELECT item_id AS q, b.text, e.embedding::DOUBLE[] AS v FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""
DENSE = f"""dense_all AS MATERIALIZED (SELECT q, doc, pos, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM
 (SELECT a.q, c.doc, c.pos, {S.cosine('', 'a.v', 'c.v')} AS score FROM asked a, corpus c WHERE a.v IS NOT NULL AND c.v IS NOT NULL))"""
BM25 = S.bm25("corpus", "asked")
NEAR = f"""pairs AS (SELECT a.q, e.vec_id AS doc, {S.cosine('', 'a.v', 'e.embedding::DOUBLE[]')} AS score FROM asked a, embeddings e WHERE a.v IS NOT NULL),
near AS MATERIALIZED (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM pairs),
relevant AS (SELECT a.q, e.vec_id AS doc FROM asked a JOIN embeddings s ON s.vec_id = a.q JOIN embeddings e ON e.label = s.label)"""


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# catalog


@query("catalog_clean", f"WITH {S.CATALOG} SELECT pos, raw_facet, nf AS normalized_facet, is_blank, is_header, has_numeric_prefix, encoding_repaired, camelcase_reformatted FROM clean")
def _(t):
    return cat.cleaned(t.raw())


@query("catalog_quality_flags", f"WITH {S.CATALOG} SELECT pos, is_duplicate, quality_flag FROM flags")
def _(t):
    return cat.flagged(cat.cleaned(t.raw())).select("pos", "is_duplicate", "quality_flag")


@query("catalog_taxonomy", f"WITH {S.CATALOG} SELECT pos, facet_type, conversation_observable, sensitivity, scoring_definition, scoring_anchors, abstention_reason FROM catalog")
def _(t):
    return cat.classified(cat.cleaned(t.raw())).select("pos", "facet_type", "conversation_observable", "sensitivity", "scoring_definition", "scoring_anchors", "abstention_reason")


@query("catalog_ids", f"WITH {S.CATALOG} SELECT pos, facet_id, raw_facet FROM catalog")
def _(t):
    return cat.with_ids(cat.cleaned(t.raw())).select("pos", "facet_id", "raw_facet")


_FLAGS = ["blank", "duplicate", "header_row", "number_prefix_stripped", "encoding_repaired", "camelcase_reformatted", "valid"]


@query("catalog_statistics", f"""WITH {S.CATALOG} SELECT count(*) AS total_rows, count_if(quality_flag = 'valid') AS valid_rows, count_if(quality_flag = 'header_row') AS header_rows, count_if(quality_flag = 'blank') AS malformed_rows,
 count_if(is_duplicate) AS duplicates, count_if(conversation_observable) AS observable_rows, count_if(NOT conversation_observable) AS unobservable_rows FROM catalog""")
def _(t):
    return cat.statistics(t.catalog())


@query("catalog_audit_counts", f"WITH {S.CATALOG}, a AS (SELECT count(*) AS total, {', '.join(f'''count_if(quality_flag = '{f}') AS n_{f}''' for f in _FLAGS)}, count_if(conversation_observable) AS observable FROM catalog) SELECT *, round(observable / total * 100, 2) AS observable_pct, round(100 - round(observable / total * 100, 2), 2) AS unobservable_pct FROM a")
def _(t):
    return cat.audit(t.catalog())


@query("catalog_distributions", f"WITH {S.CATALOG} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM catalog GROUP BY {c}" for c in ("facet_type", "sensitivity", "quality_flag")))
def _(t):
    return cat.distributions(t.catalog())


@query("facet_lookup", f"WITH {S.CATALOG} SELECT facet_id, raw_facet, normalized_facet, facet_type FROM catalog WHERE facet_id = 'FACET_042'")
def _(t):
    return cat.lookup(t.catalog(), "facet_042").select("facet_id", "raw_facet", "normalized_facet", "facet_type")


@query("catalog_membership", f"WITH {S.CATALOG} SELECT pos, facet_id FROM catalog WHERE facet_type IN ('medical_biomarker', 'psychological_trait')")
def _(t):
    return t.catalog().filter(F.col("facet_type").isin("medical_biomarker", "psychological_trait")).select("pos", "facet_id")


@query("observable_prefilter", f"WITH {S.CATALOG} SELECT pos, facet_id FROM catalog WHERE conversation_observable")
def _(t):
    return cat.observable(t.catalog()).select("pos", "facet_id")


_FLAG = "CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false END"


@query("route_split", f"SELECT p_partkey, CASE WHEN {_FLAG} IS NULL OR {_FLAG} THEN 'score' ELSE 'abstain' END AS route FROM part")
def _(t):
    score, abstain = plan.routed(t.part.select("p_partkey", F.expr(_FLAG).alias("conversation_observable")))
    return score.select("p_partkey", F.lit("score").alias("route")).unionByName(abstain.select("p_partkey", F.lit("abstain").alias("route")))


@query("preroute_cases", f"""WITH {S.CATALOG}, cases AS (SELECT p_partkey AS case_id, p_name || ' level ' || p_partkey AS n FROM part UNION ALL SELECT p_partkey + 1000000, p_name || ' ' || p_type || ' trait ' || p_partkey FROM part)
SELECT case_id, CASE WHEN c.facet_id IS NULL THEN 'unknown' WHEN NOT c.conversation_observable THEN 'not_observable' ELSE 'model' END AS route FROM cases LEFT JOIN (SELECT lower(normalized_facet) AS k, arg_max(facet_id, pos) AS facet_id, arg_max(conversation_observable, pos) AS conversation_observable FROM catalog GROUP BY 1) c ON c.k = lower(cases.n)""")
def _(t):
    one = t.part.select(F.col("p_partkey").alias("case_id"), F.concat_ws(" level ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    two = t.part.select((F.col("p_partkey") + 1000000).alias("case_id"), F.concat_ws(" ", "p_name", "p_type", F.lit("trait"), F.col("p_partkey").cast("string")).alias("name"))
    known = t.catalog().groupBy(text.match_key(F.col("normalized_facet")).alias("k")).agg(F.max_by(F.struct("facet_id", "conversation_observable"), "pos").alias("c"))
    cases = one.unionByName(two).withColumn("k", text.match_key(F.col("name"))).join(known, "k", "left")
    return cases.select("case_id", F.when(F.col("c").isNull(), "unknown").when(~F.col("c.conversation_observable"), "not_observable").otherwise("model").alias("route"))


# text


@query("input_validation", f"SELECT 'd' || doc_id AS id, CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'blank' WHEN length(text) > 10000 THEN 'too long' END AS error FROM documents UNION ALL SELECT 'c' || conv_id || '.' || turn, CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'blank' WHEN length(text) > 10000 THEN 'too long' END FROM conversations")
def _(t):
    d = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    return d.unionByName(c).select("id", text.input_error(F.col("text")).alias("error"))


_TOP_K = "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE (turn * 17 + conv_id) % 60 END"


@query("request_validation", f"SELECT conv_id, turn, CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'blank' WHEN NOT coalesce({_TOP_K}, 10) BETWEEN 1 AND 50 THEN 'top_k out of range' END AS error, coalesce({_TOP_K}, 10)::BIGINT AS top_k FROM conversations")
def _(t):
    asked = t.conversations.select("conv_id", "turn", "text", F.expr(_TOP_K).cast("long").alias("top_k"))
    accepted, rejected = plan.split_requests(asked)
    return accepted.withColumn("error", F.lit(None).cast("string")).unionByName(rejected).select("conv_id", "turn", "error", "top_k")


@query("conversation_fold", f"WITH {S.CONVERSATIONS} SELECT * FROM folded")
def _(t):
    return t.folded()


@query("tokenize_terms", f"SELECT doc_id, array_to_string(list_sort({S.terms('text')}), ' ') AS terms, len({S.terms('text')}) AS n FROM documents")
def _(t):
    found = spread(t.documents).select("doc_id", F.struct(F.array_sort(text.terms(F.col("text"))).alias("terms")).alias("made"))
    line = F.transform(F.array("made"), lambda m: F.struct(F.array_join(m["terms"], " ").alias("terms"), F.size(m["terms"]).cast("long").alias("n")))[0]
    return found.select("doc_id", line.alias("line")).select("doc_id", "line.terms", "line.n")


_FIRST = S.words(f"replace(lower({S.camel('text')}), '-', ' ')")


@query("tokenize_bigrams", f"SELECT doc_id, array_to_string(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1]), ' ') AS bigrams FROM (SELECT doc_id, {_FIRST} AS w FROM documents)")
def _(t):
    return spread(t.documents).select("doc_id", F.array_join(text.bigrams(text.split_words(F.col("text"))), " ").alias("bigrams"))


_STOP = ", ".join(map(S.q, text.STOP_WORDS))
_SYN = ", ".join(f"({S.q(k)}, {S.q(v)})" for k, vs in text.SYNONYMS.items() for v in vs)


@query("query_expansion", f"""WITH syn(k, v) AS (VALUES {_SYN}), asked AS (SELECT item_id, text || ' skydiving voted the Python' AS text FROM benchmark),
own AS (SELECT item_id, unnest(list_filter({S.words('lower(text)')}, lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS w FROM asked),
every AS (SELECT item_id, w FROM own UNION SELECT item_id, v FROM own JOIN syn ON k = w)
SELECT item_id, {S.strip("any_value(text) || ' ' || coalesce(string_agg(w, ' ' ORDER BY w) FILTER (w IS NOT NULL), '')")} AS expanded, count(w) AS n_terms FROM asked LEFT JOIN every USING (item_id) GROUP BY item_id""")
def _(t):
    asked = t.benchmark.select("item_id", F.concat("text", F.lit(" skydiving voted the Python")).alias("text"))
    return asked.select("item_id", text.expand_query(F.col("text")).alias("expanded"), F.size(text.expanded_terms(F.col("text"))).cast("long").alias("n_terms"))


@query("doc_text_templates", f"""WITH {S.CATALOG} SELECT facet_id, normalized_facet || ' ' || facet_type || ' ' || scoring_definition AS lexical,
 'Facet Name: ' || normalized_facet || ' | Raw Facet: ' || raw_facet || ' | Category: ' || facet_type || ' | Definition: ' || scoring_definition || ' | Keywords: k1 k2 | Conversational Utterance Examples:  ' || coalesce(abstention_reason, 'None') AS dense,
 'Facet ID: ' || facet_id || ' | Canonical Facet: ' || normalized_facet || ' | Raw Facet: ' || raw_facet || ' | Category: ' || facet_type || ' | Definition: ' || scoring_definition || ' | Scoring Rules: ' || scoring_definition || ' | Behavioral Indicators: k1, k2 | Aliases: ' || normalized_facet || ', ' || raw_facet || ', k1, k2 | Abstention Guidance: ' || coalesce(abstention_reason, 'None') AS enriched FROM catalog""")
def _(t):
    name, raw, kind, definition, reason = (F.col(c) for c in ("normalized_facet", "raw_facet", "facet_type", "scoring_definition", "abstention_reason"))
    keywords, none = F.array(F.lit("k1"), F.lit("k2")), F.array().cast("array<string>")
    return t.catalog().select("facet_id", text.lexical_text(name, kind, definition).alias("lexical"), text.dense_text(name, raw, kind, definition, keywords, none, reason).alias("dense"), text.enriched_text(F.col("facet_id"), name, raw, kind, definition, keywords, reason).alias("enriched"))


@query("rich_text_template", f"""WITH {S.CATALOG} SELECT facet_id, 'Facet Name: ' || normalized_facet || ' | Raw Facet: ' || raw_facet || ' | Type: ' || facet_type || ' | Definition:  | Scoring Rules: ' || scoring_definition || ' | Keywords: k1, k2 | Abstention Reason: ' || coalesce(abstention_reason, 'None') AS rich FROM catalog""")
def _(t):
    name, raw, kind, rules, reason = (F.col(c) for c in ("normalized_facet", "raw_facet", "facet_type", "scoring_definition", "abstention_reason"))
    return t.catalog().select("facet_id", text.rich_text(name, raw, kind, F.lit(None).cast("string"), rules, F.array(F.lit("k1"), F.lit("k2")), reason).alias("rich"))


_BRANCHES = " ".join(f"WHEN {S.any_of('lower(nf)', w)} THEN [{S.q(a)}, {S.q(b)}]" for w, (a, b) in text.EXAMPLES)
_GENERIC = ", ".join(f"{S.q(g.split('{}')[0])} || nf || {S.q(g.split('{}')[1])}" for g in text.GENERIC_EXAMPLES)


@query("multi_example_enrichment", f"WITH {S.CATALOG} SELECT pos, array_to_string(list_concat([{_GENERIC}], CASE {_BRANCHES} ELSE [] END)[1:4], ' ; ') AS examples FROM clean")
def _(t):
    return cat.cleaned(t.raw()).select("pos", F.array_join(text.examples(F.col("normalized_facet")), " ; ").alias("examples"))


@query("enrichment_merge", "SELECT p_partkey, coalesce(n.name, p.p_name) AS name FROM part p LEFT JOIN (SELECT doc_id AS p_partkey, max(lang || ' ' || source) AS name FROM documents GROUP BY doc_id) n USING (p_partkey)")
def _(t):
    new = t.documents.groupBy(F.col("doc_id").alias("p_partkey")).agg(F.max(F.concat_ws(" ", "lang", "source")).alias("new"))
    return t.part.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_name").alias("name"))


@query("text_helpers", f"""SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS snippet, left(text, 60) || '...' AS always, lower({S.strip("regexp_replace(source || '::', ':+$', '')")}) AS match_key, source || ':' AS display FROM documents""")
def _(t):
    c, name = F.col("text"), F.concat("source", F.lit("::"))
    return t.documents.select("doc_id", text.snippet(c).alias("snippet"), text.snippet(c, 60, True).alias("always"), text.match_key(name).alias("match_key"), text.display_name(name).alias("display"))


# retrieval


@query("bm25_idf", f"WITH {CORPUS}, {BM25} SELECT tok AS token, df, round(idf, 9) AS idf FROM b_df")
def _(t):
    return ret.idf(t.indexed()).select("token", "df", F.round("idf", 9).alias("idf"))


@query("bm25_idf_unfloored", f"WITH {CORPUS}, {BM25} SELECT tok AS token, df, round(ln((any_value(n) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 9) AS idf FROM b_df, b_st GROUP BY tok, df")
def _(t):
    return ret.idf(t.indexed(), floor=None).select("token", "df", F.round("idf", 9).alias("idf"))


@query("bm25_topk", f"WITH {CORPUS}, {BM25} SELECT q AS query_id, doc AS doc_id, score, rank FROM b_all WHERE rank <= 10")
def _(t):
    return ret.bm25_top(t.indexed(), t.asked(), 10).select("query_id", "doc_id", "score", "rank")


@query("bm25_kept_index", f"""WITH {CORPUS}, {BM25}, short AS (SELECT q, array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM asked), {S.bm25('corpus', 'short', 'x')}
SELECT 'whole' AS kind, q AS query_id, doc AS doc_id, score, rank FROM b_all WHERE rank <= 10 UNION ALL SELECT 'short', q, doc, score, rank FROM x_all WHERE rank <= 5""")
def _(t):
    """An index that is built once, opened again by its path and searched for two sets of queries."""
    index = postings.opened(t.spark, postings.build(t.corpus()).path)
    short = t.asked().withColumn("text", F.substring_index("text", " ", 3))
    lists = [postings.search(index, asked, k).found.select(F.lit(kind).alias("kind"), "query_id", "doc_id", "score", "rank") for kind, asked, k in (("whole", t.asked(), 10), ("short", short, 5))]
    return lists[0].unionByName(lists[1])


@query("bm25_all_docs_rank", f"WITH {CORPUS}, {BM25} SELECT q AS query_id, doc AS doc_id, rank FROM b_all")
def _(t):
    return ret.bm25_all(t.indexed(), t.asked()).select("query_id", "doc_id", "rank")


_TF = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"


@query("tf_cosine_topk", f"""WITH {CORPUS}, d AS (SELECT doc, pos, term, count(*) AS c FROM (SELECT doc, pos, unnest({_TF}) AS term FROM corpus) GROUP BY ALL), dn AS (SELECT doc, sqrt(sum(c * c)) AS n FROM d GROUP BY doc),
qq AS (SELECT q, term, count(*) AS c FROM (SELECT q, unnest({_TF}) AS term FROM asked) WHERE term IN (SELECT term FROM d) GROUP BY ALL), qn AS (SELECT q, sqrt(sum(c * c)) AS n FROM qq GROUP BY q),
s AS (SELECT q, doc, pos, round(sum(qq.c * d.c / qn.n / dn.n), 9) AS score FROM qq JOIN d USING (term) JOIN dn USING (doc) JOIN qn USING (q) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM s)
SELECT q AS query_id, doc AS doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def _(t):
    return ret.term_cosine(t.corpus(), t.asked(), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_TW = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: length(w) >= 2)"
_TB = f"(SELECT list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1])) FROM (SELECT {_TW} AS w))"


@query("tfidf_cosine_topk", f"""WITH {CORPUS}, d0 AS (SELECT doc, pos, term, count(*) AS c FROM (SELECT doc, pos, unnest({_TB}) AS term FROM corpus) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM d0 GROUP BY term), d AS (SELECT doc, pos, term, c * idf AS c FROM d0 JOIN i USING (term)), dn AS (SELECT doc, sqrt(sum(c * c)) AS n FROM d GROUP BY doc),
qq AS (SELECT q, term, count(*) * any_value(idf) AS c FROM (SELECT q, unnest({_TB}) AS term FROM asked) JOIN i USING (term) GROUP BY q, term), qn AS (SELECT q, sqrt(sum(c * c)) AS n FROM qq GROUP BY q),
s AS (SELECT q, doc, pos, round(sum(qq.c * d.c / qn.n / dn.n), 9) AS score FROM qq JOIN d USING (term) JOIN dn USING (doc) JOIN qn USING (q) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM s)
SELECT q AS query_id, doc AS doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def _(t):
    return ret.term_cosine(t.corpus(), t.asked(), 10, inverse=True).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("dense_cosine_topk", f"WITH {CORPUS}, {DENSE} SELECT q AS query_id, doc AS doc_id, round(score, 6) AS score, rank FROM dense_all WHERE rank <= 10")
def _(t):
    return ret.dense_top(t.dense(), t.asked(), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("lsa_topk")
def _(t):
    """No SQL decomposes a matrix; tests hold the values and the order against numpy."""
    return ret.lsa_top(t.corpus(), t.asked(), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_RRF = "row_number() OVER (PARTITION BY q ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, doc)"


def _pool(n: int) -> str:
    return f"pooled AS (SELECT coalesce(b.q, d.q) AS q, coalesce(b.doc, d.doc) AS doc, b.rank AS r1, d.rank AS r2, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 12) AS score FROM (SELECT * FROM b_all WHERE rank <= {n}) b FULL JOIN (SELECT * FROM dense_all WHERE rank <= {n}) d ON b.q = d.q AND b.doc = d.doc)"


@query("rrf_hybrid_topk", f"WITH {CORPUS}, {BM25}, {DENSE}, {_pool(1000000000)}, r AS (SELECT *, {_RRF} AS rank FROM pooled) SELECT q AS query_id, doc AS doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10")
def _(t):
    return ret.rrf_complete(t.indexed(), t.dense(), t.asked(), 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("rrf_pooled_topk", f"WITH {CORPUS}, {BM25}, {DENSE}, {_pool(50)}, r AS (SELECT *, {_RRF} AS rank FROM pooled) SELECT q AS query_id, doc AS doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10")
def _(t):
    return _pooled(t).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def _lists(t: Tables, n: int) -> list[DataFrame]:
    """The first n of the lexical and of the dense list, stored, as plans use them in several branches."""
    return [stored(ret.bm25_top(t.indexed(), t.asked(), n)), stored(ret.dense_top(t.dense(), t.asked(), n))]


def _pooled(t: Tables, n: int = 50, k: int = 10) -> DataFrame:
    return ret.rrf(_lists(t, n), k)


def _expanded(t: Tables) -> DataFrame:
    return t.asked().select("query_id", F.concat("text", F.lit(" the of")).alias("text"))


@query("rrf_three_way", f"""WITH {CORPUS}, more AS (SELECT q, text || ' the of' AS text FROM asked), {BM25}, {DENSE}, {S.bm25('corpus', 'more', 'x')},
u AS (SELECT q, doc, 1 AS l, rank FROM b_all WHERE rank <= 50 UNION ALL SELECT q, doc, 2, rank FROM dense_all WHERE rank <= 50 UNION ALL SELECT q, doc, 3, rank FROM x_all WHERE rank <= 50),
f AS (SELECT q, doc, max(rank) FILTER (l = 1) AS r1, max(rank) FILTER (l = 2) AS r2, max(rank) FILTER (l = 3) AS r3, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY q, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, r3 NULLS LAST, doc) AS rank FROM f) SELECT q AS query_id, doc AS doc_id, rank FROM r WHERE rank <= 10""")
def _(t):
    return ret.rrf([*_lists(t, 50), ret.bm25_top(t.indexed(), _expanded(t), 50)], 10).select("query_id", "doc_id", "rank")


def _weighted(name: str, asked: str) -> str:
    """The first 100 of the weighted term cosine of the texts asked, over the documents' terms (w_d, w_i, w_n)."""
    return f"""{name}q AS (SELECT q, term, count(*) * any_value(idf) AS c FROM (SELECT q, unnest({_TB}) AS term FROM {asked}) JOIN w_i USING (term) GROUP BY q, term), {name}n AS (SELECT q, sqrt(sum(c * c)) AS n FROM {name}q GROUP BY q),
{name}s AS (SELECT q, doc, pos, round(sum(a.c * w_d.c / b.n / w_n.n), 9) AS score FROM {name}q a JOIN w_d USING (term) JOIN w_n USING (doc) JOIN {name}n b USING (q) GROUP BY ALL), {name}_top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM {name}s QUALIFY rank <= 100)"""


@query("rrf_tri_fusion", f"""WITH {CORPUS}, {BM25}, more AS (SELECT q, text || ' skydiving risk' AS text FROM asked), w_0 AS (SELECT doc, pos, term, count(*) AS c FROM (SELECT doc, pos, unnest({_TB}) AS term FROM corpus) GROUP BY ALL),
w_i AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM w_0 GROUP BY term), w_d AS MATERIALIZED (SELECT doc, pos, term, c * idf AS c FROM w_0 JOIN w_i USING (term)), w_n AS (SELECT doc, sqrt(sum(c * c)) AS n FROM w_d GROUP BY doc), {_weighted('s', 'asked')}, {_weighted('e', 'more')},
u AS (SELECT q, doc, 1 AS l, rank FROM b_all WHERE rank <= 100 UNION ALL SELECT q, doc, 2, rank FROM s_top UNION ALL SELECT q, doc, 3, rank FROM e_top),
f AS (SELECT q, doc, max(rank) FILTER (l = 1) AS r1, max(rank) FILTER (l = 2) AS r2, max(rank) FILTER (l = 3) AS r3, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM u GROUP BY q, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST, r3 NULLS LAST, doc) AS rank FROM f) SELECT q AS query_id, doc AS doc_id, rank FROM r WHERE rank <= 10""")
def _(t):
    asked = t.asked().select("query_id", "text")
    expanded = asked.withColumn("text", F.concat("text", F.lit(" skydiving risk")))
    return ret.tri_fusion(ret.bm25_top(t.indexed(), t.asked(), 100), t.corpus(), asked, expanded, 10).select("query_id", "doc_id", "rank")


_TIER = "u AS (SELECT q, doc, 0 AS tier, rank FROM b_all WHERE rank <= 10 UNION ALL SELECT q, doc, 1, rank FROM dense_all WHERE rank <= 10), o AS (SELECT q, doc, min(tier * 1000 + rank) AS place FROM u GROUP BY q, doc), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS rank FROM o)"


@query("tiered_union", f"WITH {CORPUS}, {BM25}, {DENSE}, {_TIER} SELECT q AS query_id, doc AS doc_id, rank FROM r WHERE rank <= 20")
def _(t):
    return ret.tiered_union(_lists(t, 10)).select("query_id", "doc_id", "rank")


@query("threshold_filter", f"WITH {CORPUS}, {BM25}, {DENSE} SELECT d.q AS query_id, d.doc AS doc_id FROM dense_all d JOIN b_all b ON b.q = d.q AND b.doc = d.doc WHERE d.rank <= 20 AND NOT (d.score < 0.3 AND b.score <= 0)")
def _(t):
    dense = stored(ret.dense_top(t.dense(), t.asked(), 20).select("query_id", "doc_id", F.col("score").alias("dense_score")))
    both = dense.join(ret.Lexical(t.indexed(), t.asked()).of(dense).select("query_id", "doc_id", F.col("score").alias("bm25_score")), ["query_id", "doc_id"], "left")
    return ret.above_threshold(both.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0))), 0.3).select("query_id", "doc_id")


@query("rerank_topk", f"""WITH {CORPUS}, {BM25}, c AS (SELECT q, doc, rank FROM b_all WHERE rank <= 30), qt AS (SELECT q, list(tok) AS t FROM b_qt GROUP BY q), dt AS (SELECT doc, t FROM b_dl),
s AS (SELECT q, doc, rank, round(coalesce(len(list_intersect(qt.t, dt.t)), 0) / greatest(coalesce(len(qt.t), 0), 1), 6) AS score FROM c LEFT JOIN qt USING (q) JOIN dt USING (doc)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS new_rank FROM s)
SELECT q AS query_id, doc AS doc_id, score AS reranker_score, new_rank FROM r WHERE new_rank <= 10""")
def _(t):
    pool = stored(ret.bm25_top(t.indexed(), t.asked(), ret.rerank_pool(10, True)).select("query_id", "doc_id", "rank"))
    texts = F.broadcast(pool.join(t.asked().select("query_id", F.col("text").alias("query_text")), "query_id")).join(t.corpus().select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    return ret.rerank(texts).select("query_id", "doc_id", "reranker_score", "new_rank")


_TARGET = "targets AS (SELECT item_id AS q, item_id AS doc FROM benchmark)"


def _targets(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))


@query("target_rank", f"WITH {CORPUS}, {BM25}, {_TARGET} SELECT t.q AS query_id, t.doc AS doc_id, coalesce(min(rank), 999) AS target_rank FROM targets t LEFT JOIN (SELECT * FROM b_all WHERE rank <= 30) b ON b.q = t.q AND b.doc = t.doc GROUP BY t.q, t.doc")
def _(t):
    return ret.target_rank(ret.bm25_top(t.indexed(), t.asked(), 30), _targets(t))


@query("target_inclusion", f"WITH {CORPUS}, {BM25}, {_TARGET}, c AS (SELECT q, doc, rank FROM b_all WHERE rank <= 10) SELECT q AS query_id, doc AS doc_id, rank FROM c UNION ALL SELECT t.q, t.doc, coalesce((SELECT max(rank) FROM c WHERE c.q = t.q), 0) + 1 FROM targets t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.q = t.q AND c.doc = t.doc)")
def _(t):
    return ret.include_target(ret.bm25_top(t.indexed(), t.asked(), 10), _targets(t))


@query("topk_pivot", f"WITH {CORPUS}, {BM25} SELECT q AS query_id, {', '.join(f'''coalesce(max(doc::VARCHAR) FILTER (rank = {i}), '') AS top{i}''' for i in range(1, 11))} FROM b_all WHERE rank <= 10 GROUP BY q")
def _(t):
    return ret.pivot_top(ret.bm25_top(t.indexed(), t.asked(), 10))


# prompts, backends, parsing


def _candidates(t: Tables) -> DataFrame:
    """The ten entries retrieved for every conversation, with the conversation's text."""
    talk, catalog = t.accepted(), t.kept_catalog()
    found = stored(plan.retrieve(talk, catalog, 10).select(F.col("query_id").alias("conv_id"), F.col("doc_id").alias("facet_id"), "rank"))
    return plan.entries_of(found, catalog).join(talk, "conv_id")


_SEARCH = f"""{S.CATALOG}, {S.CONVERSATIONS}, ok AS MATERIALIZED (SELECT conv_id AS q, {S.strip('text')} AS text FROM folded WHERE {S.strip('text')} <> '' AND length(text) <= 10000),
entries AS MATERIALIZED (SELECT facet_id AS doc, pos, normalized_facet || ' ' || facet_type || ' ' || scoring_definition AS text FROM catalog WHERE conversation_observable), {S.bm25('entries', 'ok')}"""
_CAND = f"{_SEARCH}, cand AS (SELECT a.q AS conv_id, ok.text, a.rank, c.* FROM b_all a JOIN catalog c ON c.facet_id = a.doc JOIN ok ON ok.q = a.q WHERE a.rank <= 10)"


@query("batch_assignment", f"WITH {_CAND} SELECT conv_id, facet_id, rank, ((rank - 1) // 4)::INT AS batch FROM cand")
def _(t):
    return sc.batches(_candidates(t), 4).select("conv_id", "facet_id", "rank", "batch")


@query("prompt_build", f"""WITH {_CAND}, n AS (SELECT *, ((rank - 1) // 4)::INT AS batch, row_number() OVER (PARTITION BY conv_id, (rank - 1) // 4 ORDER BY rank) AS i FROM cand),
b AS (SELECT *, 'Candidate ' || i || ':' || chr(10) || '  - Facet ID: ' || facet_id || chr(10) || '  - Facet Name: ' || normalized_facet || chr(10) || '  - Type: ' || facet_type || chr(10) || '  - Definition: ' || scoring_definition || chr(10) || '  - Anchors: ' || coalesce(nullif(scoring_anchors, ''), 'High/Low behavioral indicators') || chr(10) AS block FROM n)
SELECT conv_id, batch, count(*) AS n_candidates, '[CONVERSATION TRANSCRIPT]' || chr(10) || '"' || {S.strip('any_value(text)')} || '"' || chr(10) || chr(10) || '[CANDIDATE FACETS TO EVALUATE]' || chr(10) || string_agg(block, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Evaluate each candidate facet above strictly against the conversation transcript.' || chr(10) || 'Return a JSON array containing exactly ' || count(*) || ' objects.' || chr(10) AS prompt FROM b GROUP BY conv_id, batch""")
def _(t):
    return sc.prompts(sc.batches(_candidates(t), 4))


@query("prompt_harness", f"""WITH {_CAND} SELECT conv_id, ((rank - 1) // 4)::INT AS batch, count(*) AS n_candidates, 'CONVERSATION TEXT:' || chr(10) || '"' || any_value(text) || '"' || chr(10) || chr(10) || 'CANDIDATE FACETS:' || chr(10)
 || string_agg('- [' || facet_id || '] ' || trim(regexp_replace(trim(normalized_facet), ':$', '')) || ': ' || scoring_definition, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Output JSON array:' AS prompt FROM cand GROUP BY conv_id, (rank - 1) // 4""")
def _(t):
    return sc.harness_prompts(sc.batches(_candidates(t), 4))


_RULE = S.rule_fields("low", "conv")


@query("rule_backend_scores", f"WITH {_CAND}, r AS (SELECT conv_id, facet_id, lower(normalized_facet) AS low, lower(string_split({S.strip('text')}, '\"')[1]) AS conv FROM cand) SELECT conv_id, facet_id, {', '.join(f'{v} AS {k}' for k, v in _RULE.items())} FROM r")
def _(t):
    r = sc.rule_result(F.col("facet_id"), F.col("normalized_facet"), F.col("cues"))
    about = t.accepted().select("conv_id", sc.cues(F.col("text")).alias("cues"))
    return _candidates(t).drop("text").join(about, "conv_id").select("conv_id", r.alias("r")).select("conv_id", "r.facet_id", "r.status", "r.score", "r.confidence", "r.evidence")


_O = """'{"facet_id": "F' || %d || '", "facet": "' || p_name || '", "status": "%s", "score": %s, "confidence": 0.7, "evidence": "%s", "reason": "because ' || p_partkey || '"}'"""


def _obj(i: int, status: str = "scored", score: str = "' || (1 + p_partkey % 5) || '", evidence: str = "said so") -> str:
    return _O % (i, status, score, evidence)


def _parse_query(name: str, output: str, expected: dict[int, str]) -> None:
    """All rows of part as outputs of one form. expected: candidate number to (status, score, confidence, evidence, reason)."""

    def run(t: Tables) -> DataFrame:
        outputs = t.part.select(F.col("p_partkey").alias("conv_id"), F.lit(0).alias("batch"), F.expr(output).alias("raw_output"))
        wanted = t.part.select(F.col("p_partkey").alias("conv_id"), F.lit(0).alias("batch"), F.explode(F.array(*(F.lit(i) for i in sorted(expected)))).alias("rank"), F.concat(F.lit("name of "), "p_name").alias("facet")).withColumn("facet_id", F.concat(F.lit("F"), F.col("rank").cast("string")))
        return sc.parse(outputs, wanted)

    default = "'insufficient_evidence', NULL, 0.85::DOUBLE, NULL, 'Conversational text does not express sufficient evidence for trait ''name of ' || p_name || '''.'"
    union = " UNION ALL ".join(f"SELECT p_partkey AS conv_id, {i} AS rank, 'F{i}' AS facet_id, {'''p_name''' if e != 'default' and not e.startswith('refused') else '''\'name of \' || p_name'''} AS facet, {default if e == 'default' else e.removeprefix('refused ')} FROM part" for i, e in sorted(expected.items()))
    query(name, f"SELECT conv_id, rank, facet_id, facet, status, score, confidence, evidence, reason FROM ({union}) AS x(conv_id, rank, facet_id, facet, status, score, confidence, evidence, reason)")(run)


def _want(status: str = "scored", score: str = "(1 + p_partkey % 5)::INT", evidence: str = "'said so'") -> str:
    return f"'{status}', {score}, 0.7::DOUBLE, {evidence}, 'because ' || p_partkey"


_OK = _want()
_NONE = _want("insufficient_evidence", "NULL", "NULL")
_parse_query("parse_valid", f"'[' || {_obj(1)} || ', ' || {_obj(2, 'insufficient_evidence', 'null')} || ']'", {1: _OK, 2: _NONE})
_parse_query("parse_repaired", f"'Here you are: ```json [' || {_obj(1)} || ', ' || {_obj(2)} || ',] ``` done'", {1: _OK, 2: _OK})
_parse_query("parse_refusal", f"'As an AI I may not: [' || {_obj(1)} || ']'", {1: "refused 'insufficient_evidence', NULL, 0.85::DOUBLE, NULL, 'Model refused or was unable to provide a response for this dialogue snippet.'"})
_parse_query("parse_truncated", f"'[' || {_obj(1)} || ', ' || {_obj(2)} || ', {{\"facet_id\": \"F3\", \"fac'", {1: _OK, 2: _OK, 3: "default"})
_parse_query("parse_duplicates", f"'[' || {_obj(1, score='9')} || ', ' || {_obj(1)} || ', ' || {_obj(1, score='1')} || ', ' || {_obj(7)} || ']'", {1: _OK})
_parse_query("parse_score_coercion", f"'[' || {_obj(1, score='4.7')} || ', ' || {_obj(2, score='2.5')} || ', ' || {_obj(3, score=chr(34) + '4' + chr(34))} || ']'", {1: _want(score="5"), 2: _want(score="2"), 3: _want(score="4")})
_parse_query("parse_completeness", f"{_obj(2)}", {1: "default", 2: _OK, 3: "default"})
_parse_query("evidence_nulling", f"'[' || {_obj(1, 'not_observable')} || ', ' || {_obj(2, 'perhaps')} || ', ' || {_obj(3, 'SCORED')} || ', ' || {_obj(4, evidence=' said so ')} || ']'", {1: _want("not_observable", "NULL", "NULL"), 2: _NONE, 3: "default", 4: _OK})

_STATES = [("'   '", "empty_output"), (f"'[' || {_obj(1)} || ']'", "valid_array"), ("'Sure: [1, 2]'", "valid_array"), (f"'{{\"results\": [' || {_obj(1)} || ' ]}}'", "valid_array"), ("'{\"results\": [], \"n\": [[1}'", "valid_array"), (f"'```json ' || {_obj(1)} || ' ```'", "single_object"), (f"'[' || {_obj(1)} || ', ' || {_obj(2)} || ', {{\"facet_id\": \"F3\", \"fa'", "truncated_recovery"), ("'no json here ' || p_name", "parse_error")]
_STATE_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {o}" for i, (o, _) in enumerate(_STATES)) + " END"


@query("harness_parse_states", "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(_STATES)) + " END AS state FROM part")
def _(t):
    return t.part.select("p_partkey", sc.harness_state(F.expr(_STATE_SQL)).alias("state"))


@query("harness_state_counts", "SELECT state, count(*) AS n, state NOT IN ('parse_error', 'empty_output') AS parsed FROM (SELECT CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, s) in enumerate(_STATES)) + " END AS state FROM part) GROUP BY state")
def _(t):
    return t.part.select(sc.harness_state(F.expr(_STATE_SQL)).alias("state")).groupBy("state").agg(F.count("*").alias("n")).withColumn("parsed", ~F.col("state").isin("parse_error", "empty_output"))


_H = """'{"facet_id": "F' || %d || '", "score": %s, "status": "%s", "reasoning": "as ' || p_name || '"}'"""
_READ = [("NULL", "empty_output", 0), (f"'Here: [' || {_H % (1, '4.5', 'Scored')} || ', 7, ' || {_H % (2, 'null', 'odd')} || ']'", "valid_array", 2), (f"'{{\"z\": [7, ' || {_H % (1, '4.5', 'Scored')} || ', ' || {_H % (2, 'null', 'odd')} || '], \"a\": [1]}}'", "wrapped_object", 2), (f"'```json ' || {_H % (1, '4.5', 'Scored')} || '```'", "single_object", 1), (f"'[' || {_H % (1, '4.5', 'Scored')} || ', ' || {_H % (2, 'null', 'odd')} || ', {{\"facet_id\": \"F3'", "truncated_recovery", 2), ("'{\"a\": {\"b\": [1]}, \"c\": 2, \"d\": \"[]'", "parse_error", 0)]
_READ_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {o}" for i, (o, _, _) in enumerate(_READ)) + " END"
_READ_STATES = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{state}'" for i, (_, state, _) in enumerate(_READ)) + " END"
_READ_COUNTS = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(_READ)) + " END"


@query("harness_parse_items", f"""WITH r AS (SELECT p_partkey, p_name, {_READ_STATES} AS state, {_READ_COUNTS} AS n FROM part)
SELECT p_partkey, state, i::INT AS place, 'F' || i AS facet_id, CASE WHEN i = 1 THEN 4.5::DOUBLE ELSE 0::DOUBLE END AS score, CASE WHEN i = 1 THEN 'scored' ELSE 'abstained' END AS status, 'medium' AS confidence, 'as ' || p_name AS reasoning FROM r, generate_series(1, n) g(i)
UNION ALL SELECT p_partkey, state, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE n = 0""")
def _(t):
    read = t.part.select("p_partkey", sc.harness_read(F.expr(_READ_SQL)).alias("r"))
    each = read.select("p_partkey", "r.state", F.posexplode_outer(sc.harness_items(F.col("r.items"))).alias("place", "i"))
    return each.select("p_partkey", "state", (F.col("place") + 1).alias("place"), "i.*")


@query("harness_two_passes", f"""WITH r AS (SELECT conv_id, p_partkey AS k, p_partkey % 6 AS f FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN part ON p_partkey = conv_id % 37 + 1),
p AS (SELECT k AS p_partkey, * FROM r UNION ALL SELECT k + 1, conv_id, k, f FROM r WHERE conv_id % 5 <> 0), s AS (SELECT conv_id, p_partkey - k AS batch, {_READ_STATES} AS state, {_READ_COUNTS} AS n, 10 + p_partkey AS ms FROM p)
SELECT conv_id, count(*) AS n_passes, sum(ms)::BIGINT AS latency_ms, sum(n)::BIGINT AS n_items, CASE WHEN max(state) FILTER (batch = 0) NOT IN ('empty_output', 'parse_error') THEN max(state) FILTER (batch = 0) ELSE coalesce(max(state) FILTER (batch = 1), 'valid_array') END AS state FROM s GROUP BY conv_id""")
def _(t):
    talk = t.conversations.select("conv_id").distinct().withColumn("k", F.col("conv_id") % 37 + 1).select("conv_id", "k", F.explode(F.expr("CASE WHEN conv_id % 5 = 0 THEN array(0) ELSE array(0, 1) END")).alias("batch"))
    read = talk.withColumn("p_partkey", F.col("k") + F.col("batch")).join(t.part.select("p_partkey", sc.harness_read(F.expr(_READ_SQL)).alias("r")), "p_partkey")
    passes = read.select("conv_id", "batch", "r.state", sc.harness_items(F.col("r.items")).alias("items"), (F.col("p_partkey") + 10).cast("long").alias("latency_ms"))
    return sc.merged_passes(passes).select("conv_id", "n_passes", "latency_ms", F.size("items").cast("long").alias("n_items"), "state")


@query("harness_schema", "SELECT p_partkey, 'F' || p_partkey AS facet_id, CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE WHEN p_partkey % 3 = 1 THEN 0::DOUBLE ELSE 4::DOUBLE END AS score, CASE WHEN p_partkey % 2 = 0 THEN 'scored' WHEN p_partkey % 3 = 1 THEN 'abstained' ELSE 'scored' END AS status FROM part")
def _(t):
    item = F.struct(F.concat(F.lit(" F"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("facet_id"), F.lit(None).cast("string").alias("facet"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '2.5' WHEN 1 THEN 'n/a' ELSE '4' END").alias("score"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN ' Scored' ELSE 'odd' END").alias("status"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
    return t.part.select("p_partkey", item.alias("i")).select("p_partkey", sc.harness_item(F.col("i")).alias("h")).select("p_partkey", "h.facet_id", "h.score", "h.status")


# names and matching


_KEY = S.strip("regexp_replace({}, ':+$', '')")


def _cascade(names: str) -> str:
    """names: SQL of name_id, name, y (what is looked for), is_alias."""
    low = f"lower({_KEY.format('normalized_facet')})"
    return f"""WITH {S.CATALOG}, names AS ({names}), k AS (SELECT *, lower({_KEY.format('y')}) AS low FROM names), n1 AS (SELECT normalized_facet AS x, arg_max(facet_id, pos) AS f FROM catalog WHERE normalized_facet <> '' GROUP BY 1),
r1 AS (SELECT raw_facet AS x, arg_max(facet_id, pos) AS f FROM catalog WHERE raw_facet <> '' GROUP BY 1), l1 AS (SELECT {low} AS x, arg_max(facet_id, pos) AS f FROM catalog WHERE normalized_facet <> '' GROUP BY 1),
e AS (SELECT k.*, n1.f AS a, r1.f AS b, l1.f AS c FROM k LEFT JOIN n1 ON n1.x = y LEFT JOIN r1 ON r1.x = y LEFT JOIN l1 ON l1.x = low),
h AS (SELECT low, arg_min(facet_id, pos) AS f FROM (SELECT DISTINCT low FROM e WHERE coalesce(a, b, c) IS NULL) z JOIN catalog ON contains({low}, low) GROUP BY low)
SELECT name_id, name, coalesce(a, b, c, h.f) AS facet_id, CASE WHEN a IS NOT NULL AND is_alias THEN 'alias' WHEN a IS NOT NULL THEN 'normalized' WHEN b IS NOT NULL THEN 'raw' WHEN c IS NOT NULL THEN 'lower' WHEN h.f IS NOT NULL THEN 'contains' ELSE 'none' END AS matched_by FROM e LEFT JOIN h USING (low)"""


_NAMES = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type || ' trait ' || p_partkey WHEN 1 THEN upper(p_name || ' hostility ' || p_partkey || ':') WHEN 2 THEN 'hostility ' || p_partkey ELSE p_name || ' unknown' END"
_NICK = "CASE WHEN p_partkey % 2 = 0 THEN 'Nick:' ELSE p_name || ' ' || p_type || ' trait ' || p_partkey END"


@query("name_resolution_cascade", _cascade(f"SELECT p_partkey AS name_id, {_NAMES} AS name, {_NAMES} AS y, false AS is_alias FROM part"))
def _(t):
    return ev.resolve_names(t.part.select(F.col("p_partkey").alias("name_id"), F.expr(_NAMES).alias("name")), t.kept_catalog())


@query("alias_resolution", _cascade(f"SELECT p_partkey AS name_id, {_NICK} AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Self Esteem' ELSE {_NICK} END AS y, p_partkey % 2 = 0 AS is_alias FROM part"))
def _(t):
    names = t.part.select(F.col("p_partkey").alias("name_id"), F.expr(_NICK).alias("name"))
    return ev.resolve_names(names, t.kept_catalog(), t.spark.createDataFrame([("nick", "Self Esteem")], "alias string, target string"))


@query("theta_contains_match", "WITH r AS (SELECT conv_id AS case_id, turn AS pos, lower(trim(text)) AS own FROM conversations), w AS (SELECT DISTINCT conv_id AS case_id, 'the' AS want FROM conversations), j AS (SELECT w.case_id, r.pos, coalesce(own = want OR contains(own, want) OR contains(want, own), false) AS hit FROM w JOIN r USING (case_id)) SELECT case_id, 'the' AS expected, bool_or(hit) AS matched, coalesce(min(pos) FILTER (hit), min(pos)) AS pos FROM j GROUP BY case_id")
def _(t):
    results = t.conversations.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), F.trim("text").alias("facet"))
    wanted = t.conversations.select(F.col("conv_id").alias("case_id"), F.lit("the").alias("expected")).distinct()
    return ev.contains_match(results, wanted, both_ways=True, fallback=True).select("case_id", "expected", "matched", "pos")


@query("result_match", "WITH r AS (SELECT conv_id AS case_id, turn AS pos, 'F' || turn AS facet_id, CASE WHEN turn % 2 = 1 THEN 'scored' ELSE 'insufficient_evidence' END AS status FROM conversations), j AS (SELECT *, CASE WHEN facet_id = 'F' || (case_id % 7) OR contains(facet_id, 'F' || (case_id % 7)) THEN 1 WHEN status = 'scored' THEN 2 END AS match_pass FROM r) SELECT case_id, match_pass, pos, facet_id FROM j WHERE match_pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY match_pass, pos) = 1")
def _(t):
    results = t.conversations.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), F.concat(F.lit("F"), F.col("turn").cast("string")).alias("facet_id"), F.lit("x").alias("facet"), F.when(F.col("turn") % 2 == 1, "scored").otherwise("insufficient_evidence").alias("status"))
    wanted = t.conversations.select(F.col("conv_id").alias("case_id")).distinct().withColumn("facet_id", F.concat(F.lit("F"), (F.col("case_id") % 7).cast("string"))).withColumn("expected", F.lit("none"))
    return ev.result_match(results, wanted)


_WANT = "CASE conv_id % 4 WHEN 0 THEN 'F1' WHEN 1 THEN 'the:' WHEN 2 THEN '' ELSE 'no such words' END"


@query("harness_match", f"""WITH r AS (SELECT conv_id AS case_id, turn AS pos, 'F' || turn AS facet_id, lower(trim(text)) AS own FROM conversations), w AS (SELECT DISTINCT conv_id AS case_id, lower({S.strip(f"regexp_replace({_WANT}, ':+$', '')")}) AS want, 'F' || (conv_id % 3) AS want_id FROM conversations),
j AS (SELECT w.case_id, pos, facet_id FROM w JOIN r USING (case_id) WHERE (want <> '' AND contains(own, want)) OR (own <> '' AND contains(want, own)) OR lower(facet_id) = want OR facet_id = want_id) SELECT case_id, min(pos) AS pos, arg_min(facet_id, pos) AS facet_id FROM j GROUP BY case_id""")
def _(t):
    results = t.conversations.select(F.col("conv_id").alias("case_id"), F.col("turn").alias("pos"), F.concat(F.lit("F"), F.col("turn").cast("string")).alias("facet_id"), F.col("text").alias("facet"))
    wanted = t.conversations.select("conv_id").distinct().select(F.col("conv_id").alias("case_id"), F.concat(F.lit("F"), (F.col("conv_id") % 3).cast("string")).alias("facet_id"), F.expr(_WANT).alias("expected"))
    return ev.harness_match(results, wanted)


@query("curated_membership", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_member FROM documents")
def _(t):
    return ev.in_set(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id")


@query("matched_unmatched", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unmatched' ELSE 'matched' END AS side FROM (SELECT doc_id * 2 AS doc_id FROM labels) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)")
def _(t):
    yes, no = ev.split_matched(t.labels.select((F.col("doc_id") * 2).alias("doc_id")), t.documents.select("doc_id").distinct(), "doc_id")
    return yes.withColumn("side", F.lit("matched")).unionByName(no.withColumn("side", F.lit("unmatched")))


@query("set_overlap", f"WITH {CORPUS}, {BM25}, {DENSE} SELECT b.q AS query_id, count(d.doc) AS n_common FROM (SELECT * FROM b_all WHERE rank <= 10) b LEFT JOIN (SELECT * FROM dense_all WHERE rank <= 10) d ON b.q = d.q AND b.doc = d.doc GROUP BY b.q")
def _(t):
    a, b = _lists(t, 10)
    return a.select("query_id", "doc_id").join(b.select("query_id", "doc_id", F.lit(1).alias("both")), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("both").alias("n_common"))


# metrics


@query("gold_join_default", f"WITH {JUDGED} SELECT * FROM judged")
def _(t):
    return t.judged()


_PCT = "round(coalesce({} / nullif({}::DOUBLE, 0), 0) * 100, 2)"
_EA, _PA = "expected_status IN ('insufficient_evidence', 'not_observable')", "predicted_status IN ('insufficient_evidence', 'not_observable')"


@query("status_accuracy", f"WITH {JUDGED} SELECT count(*) AS n, {_PCT.format('count_if(expected_status = predicted_status)', 'count(*)')} AS strict_pct, {_PCT.format(f'count_if(expected_status = predicted_status OR ({_EA} AND {_PA}))', 'count(*)')} AS lenient_pct FROM judged")
def _(t):
    return ev.status_accuracy(t.judged())


def _prf(right: str) -> str:
    return f"WITH {JUDGED}, b AS (SELECT count_if({right}) AS tp, count_if({_PA}) AS n_pred, count_if({_EA}) AS n_exp FROM judged), p AS (SELECT *, round(tp / greatest(n_pred, 1) * 100, 2) AS precision_pct, round(tp / greatest(n_exp, 1) * 100, 2) AS recall_pct FROM b) SELECT *, round(2 * precision_pct * recall_pct / greatest(precision_pct + recall_pct, 0.00001::DOUBLE), 2) AS f1_pct FROM p"


@query("abstention_prf", _prf(f"{_EA} AND {_PA}"))
def _(t):
    return ev.abstention_prf(t.judged())


@query("abstention_prf_strict", _prf(f"{_PA} AND expected_status = predicted_status"))
def _(t):
    return ev.abstention_prf(t.judged(), lenient=False)


@query("score_error", f"WITH {JUDGED}, g AS (SELECT *, abs(predicted_score - expected_score) AS g FROM judged) SELECT count(g) AS n_pairs, round(coalesce(avg(g), 0), 4) AS mae, {_PCT.format('count_if(g = 0)', 'count(g)')} AS exact_pct, {_PCT.format('count_if(g <= 1)', 'count(g)')} AS within_one_pct, " + _PCT.format("count_if(g = 0)", "count_if(expected_status = 'scored')") + " AS exact_of_expected_pct FROM g")
def _(t):
    return ev.score_error(t.judged())


_FS = "count_if(expected_status = 'not_observable' AND predicted_status = 'scored')"


@query("false_scoring_rate", f"WITH {JUDGED} SELECT {_FS} AS n_false, " + _PCT.format(_FS, "count_if(expected_status = 'not_observable')") + f" AS pct_of_unobservable, {_PCT.format(_FS, 'count(*)')} AS pct_of_all FROM judged")
def _(t):
    return ev.false_scoring(t.judged())


@query("confusion_matrix", f"WITH {JUDGED} SELECT expected_status, predicted_status, count(*) AS n FROM judged GROUP BY ALL")
def _(t):
    return ev.confusion_matrix(t.judged())


@query("score_distribution", f"WITH {JUDGED} SELECT predicted_score, count(*) AS n FROM judged WHERE predicted_score IS NOT NULL GROUP BY ALL")
def _(t):
    return ev.score_distribution(t.judged())


_FC = "CASE WHEN predicted_status = expected_status AND predicted_score IS NOT DISTINCT FROM expected_score THEN NULL WHEN expected_status = 'not_observable' AND predicted_status = 'scored' THEN 'false_scoring' WHEN expected_status = 'scored' AND predicted_status = 'insufficient_evidence' THEN 'mock_backend_limitation' WHEN expected_status = 'scored' AND predicted_score IS DISTINCT FROM expected_score THEN 'wrong_scoring' ELSE 'incorrect_abstention' END"


@query("failure_categories", f"WITH {JUDGED}, f AS (SELECT {_FC} AS category FROM judged) SELECT category, count(*) AS n FROM f WHERE category IS NOT NULL GROUP BY category")
def _(t):
    return t.judged().withColumn("category", ev.failure_category()).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


_LR = "*, (doc_id % 45 + 1)::INT AS target_rank, doc_id % 9 <> 0 AS target_observable"


def _ranked_rows(t: Tables) -> DataFrame:
    return t.judged().withColumns({"target_rank": (F.col("doc_id") % 45 + 1).cast("int"), "target_observable": F.col("doc_id") % 9 != 0})


@query("failure_categories_lettered", f"""WITH {JUDGED}, r AS (SELECT {_LR} FROM judged), f AS (SELECT CASE WHEN predicted_status = expected_status AND (expected_status <> 'scored' OR predicted_score IS NOT DISTINCT FROM expected_score) THEN NULL WHEN NOT target_observable AND predicted_status = 'scored' THEN 'B. Taxonomy/pre-filtering failure'
 WHEN NOT target_observable THEN 'F. Benchmark/evaluation bug' WHEN target_rank > 30 THEN 'A. Retrieval failure' WHEN expected_status = 'scored' AND predicted_status = 'insufficient_evidence' THEN 'H. Mock backend limitation' WHEN expected_status = 'scored' AND predicted_status = 'scored' THEN 'C. Scoring failure'
 WHEN {_EA} AND predicted_status = 'scored' THEN 'D. Abstention failure' ELSE 'H. Mock backend limitation' END AS category FROM r) SELECT category, count(*) AS n FROM f GROUP BY category""")
def _(t):
    return _ranked_rows(t).select(ev.lettered_category().alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("failure_categories_harness", f"""WITH {JUDGED}, r AS (SELECT {_LR} FROM judged), f AS (SELECT CASE WHEN expected_status = 'scored' AND NOT coalesce(predicted_score, 0) > 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'PARSER_FAILURE' WHEN doc_id % 5 = 0 THEN 'FACET_RESOLUTION_FAILURE' WHEN target_rank > 10 THEN 'RETRIEVAL_FAILURE' WHEN doc_id % 2 = 0 THEN 'GOLD_LABEL_FAILURE' ELSE 'MODEL_SEMANTIC_FAILURE' END
 WHEN expected_status = 'not_observable' AND coalesce(predicted_score, 0) > 0 THEN 'MODEL_SEMANTIC_FAILURE' ELSE 'NONE' END AS category FROM r) SELECT category, count(*) AS n FROM f GROUP BY category""")
def _(t):
    rows = _ranked_rows(t).withColumns({"parse_state": F.when(F.col("doc_id") % 4 == 0, "parse_error").otherwise("valid_array"), "resolved": F.col("doc_id") % 5 != 0, "valid": F.col("doc_id") % 2 != 0, "predicted_score": F.col("predicted_score").cast("double")})
    return rows.select(ev.harness_category().alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("conditioned_metrics", f"WITH {JUDGED}, r AS (SELECT {_LR}, expected_status = predicted_status AS ok FROM judged) SELECT count(*) AS n, count_if(target_rank <= 30) AS n_retrieved, {_PCT.format('count_if(ok)', 'count(*)')} AS overall_pct, {_PCT.format('count_if(ok AND target_rank <= 30)', 'count_if(target_rank <= 30)')} AS when_retrieved_pct FROM r")
def _(t):
    return ev.conditioned(_ranked_rows(t))


@query("rank_buckets", f"WITH {JUDGED}, r AS (SELECT {_LR} FROM judged) SELECT CASE WHEN target_rank <= 10 THEN 'retrieved' WHEN target_rank <= 30 THEN 'ranking_failure' ELSE 'retrieval_miss' END AS bucket, count(*) AS n FROM r GROUP BY 1")
def _(t):
    return _ranked_rows(t).groupBy(ev.rank_bucket(F.col("target_rank")).alias("bucket")).agg(F.count("*").alias("n"))


@query("distinct_annotated", "SELECT count(DISTINCT quality * 10 + toxic) AS n_kinds, count(DISTINCT doc_id) AS n_docs FROM labels")
def _(t):
    return t.labels.agg(F.count_distinct(F.struct("quality", "toxic")).alias("n_kinds"), F.count_distinct("doc_id").alias("n_docs"))


def _near(t: Tables, k: int) -> DataFrame:
    return ret.dense_top(t.vectors(), t.asked(), k)


@query("recall_at_k", f"WITH {CORPUS}, {NEAR}, h AS (SELECT r.q, " + ", ".join(f"count_if(coalesce(n.rank <= {k}, false)) / count(*) AS r{k}" for k in (5, 10, 30)) + " FROM relevant r LEFT JOIN near n ON n.q = r.q AND n.doc = r.doc GROUP BY r.q) SELECT count(*) AS n_queries, " + ", ".join(f"round(avg(r{k}) * 100, 2) AS recall_{k}" for k in (5, 10, 30)) + " FROM h")
def _(t):
    return ev.recall_at(_near(t, 30), t.ranks())


_FIRSTS = "f AS (SELECT r.q, min(n.rank) AS rank FROM (SELECT * FROM relevant WHERE q <> doc) r LEFT JOIN (SELECT * FROM near WHERE rank <= 30) n ON n.q = r.q AND n.doc = r.doc GROUP BY r.q)"


def _first(t: Tables) -> DataFrame:
    return ev.first_relevant(_near(t, 30), t.ranks().filter("query_id <> doc_id"))


@query("mrr", f"WITH {CORPUS}, {NEAR}, {_FIRSTS} SELECT count(*) AS n_queries, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM f")
def _(t):
    return ev.mrr(_first(t))


@query("ndcg", f"WITH {CORPUS}, {NEAR}, {_FIRSTS} SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 4) AS ndcg_10 FROM f")
def _(t):
    return ev.ndcg(_first(t))


@query("hit_rates", f"WITH {CORPUS}, {NEAR}, {_FIRSTS} SELECT count(*) AS n, " + ", ".join(f"round(avg((coalesce(rank, 999) <= {k})::INT) * 100, 2) AS recall_at_{k}" for k in (1, 5, 10, 20, 30)) + ", round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM f")
def _(t):
    return ev.hit_rates(_first(t).withColumnRenamed("rank", "target_rank"))


@query("top1_accuracy", f"WITH {CORPUS}, {NEAR}, {_FIRSTS}, g AS (SELECT n.q, n.doc FROM near n WHERE rank = 2) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM relevant r WHERE r.q = g.q AND r.doc = g.doc) THEN 1 ELSE 0 END) * 100, 2) AS top1_pct FROM g")
def _(t):
    second = _near(t, 2).filter("rank = 2").select("query_id", "doc_id")
    return second.join(t.ranks().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))) * 100, 2).alias("top1_pct"))


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def _(t):
    return ev.latency(t.events, "value", "event_type")


@query("component_means", "SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean_ms FROM events GROUP BY event_type")
def _(t):
    return ev.component_means(t.events, "value", "event_type")


@query("run_stability", "SELECT user_id, count(*) AS n_runs, count(DISTINCT event_type) AS n_outcomes, count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY user_id")
def _(t):
    return ev.stability(t.events, "user_id", ["event_type"])


_STRATEGIES = f"""s AS (SELECT 'bm25' AS strategy, q, doc, rank FROM b_all WHERE rank <= 30 UNION ALL SELECT 'dense', q, doc, rank FROM dense_all WHERE rank <= 30 UNION ALL SELECT 'rrf', q, doc, rank FROM (SELECT *, {_RRF} AS rank FROM pooled) WHERE rank <= 30 UNION ALL SELECT 'tiered', q, doc, rank FROM r WHERE rank <= 20),
rel AS (SELECT a.q, c.doc FROM asked a JOIN corpus c ON contains(c.text, a.text)), w AS (SELECT DISTINCT strategy, rel.q, rel.doc FROM rel, (SELECT DISTINCT strategy FROM s)),
e AS (SELECT w.strategy, w.q, min(s.rank) AS first, """ + ", ".join(f"count_if(coalesce(s.rank <= {k}, false)) / count(*) AS r{k}" for k in (5, 10, 30)) + " FROM w LEFT JOIN s ON s.strategy = w.strategy AND s.q = w.q AND s.doc = w.doc GROUP BY ALL)"


def _containing(t: Tables) -> DataFrame:
    return ret.containing(t.corpus(), t.indexed(), t.asked())


def _tagged(t: Tables) -> DataFrame:
    a, b = _lists(t, 50)
    lists = {"bm25": a.filter("rank <= 30"), "dense": b.filter("rank <= 30"), "rrf": ret.rrf([a, b], 30), "tiered": ret.tiered_union([a, b])}
    out = None
    for name, x in lists.items():
        x = x.select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank")
        out = x if out is None else out.unionByName(x)
    return out


@query("strategy_ablation", f"WITH {CORPUS}, {BM25}, {DENSE}, {_pool(50)}, {_TIER}, {_STRATEGIES} SELECT strategy, count(*) AS n_queries, " + ", ".join(f"round(avg(r{k}) * 100, 2) AS recall_{k}" for k in (5, 10, 30)) + ", round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr, round(avg((coalesce(first, 0) = 1)::INT) * 100, 2) AS top1_pct FROM e GROUP BY strategy")
def _(t):
    return ev.ablation(_tagged(t), _containing(t))


@query("rank_delta", f"WITH {CORPUS}, {BM25}, {DENSE}, {_TARGET}, x AS (SELECT t.q, t.doc, coalesce(b.rank, 999) AS rank_before, coalesce(d.rank, 999) AS rank_after FROM targets t LEFT JOIN (SELECT * FROM b_all WHERE rank <= 30) b ON b.q = t.q AND b.doc = t.doc LEFT JOIN (SELECT * FROM dense_all WHERE rank <= 30) d ON d.q = t.q AND d.doc = t.doc) SELECT q AS query_id, doc AS doc_id, rank_before, rank_after, CASE WHEN rank_after < rank_before THEN 'improved' WHEN rank_after > rank_before THEN 'lower' ELSE 'unchanged' END AS change FROM x")
def _(t):
    a, b = _lists(t, 30)
    return ev.rank_change(ret.target_rank(a, _targets(t)), ret.target_rank(b, _targets(t)), ["query_id", "doc_id"])


@query("ship_verdict", f"WITH {JUDGED}, a AS (SELECT {_PCT.format('count_if(expected_status = predicted_status)', 'count(*)')} AS strict_pct, {_PCT.format(f'count_if(expected_status = predicted_status OR ({_EA} AND {_PA}))', 'count(*)')} AS lenient_pct FROM judged) SELECT strict_pct, CASE WHEN strict_pct >= 85 THEN 'STRONG' WHEN strict_pct >= 75 THEN 'ACCEPTABLE' ELSE 'NEEDS_WORK' END AS verdict, CASE WHEN lenient_pct - strict_pct > 5 THEN 'SHIP' ELSE 'KEEP_BASELINE' END AS ship FROM a")
def _(t):
    a = ev.status_accuracy(t.judged())
    return a.select("strict_pct", ev.accuracy_verdict(F.col("strict_pct")).alias("verdict"), ev.ship_verdict(F.col("strict_pct"), F.col("lenient_pct")).alias("ship"))


@query("mixed_test_union", f"WITH {S.CATALOG} SELECT 'r' || item_id AS case_id, text FROM benchmark UNION ALL SELECT 'c' || p_partkey, p_name FROM part WHERE 'Self Esteem' IN (SELECT normalized_facet FROM catalog) AND p_partkey IN (SELECT pos FROM catalog WHERE conversation_observable)")
def _(t):
    resolved = cat.observable(t.kept_catalog()).select(F.col("pos").alias("p_partkey"))
    cases = t.part.join(resolved, "p_partkey", "left_semi").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("case_id"), F.col("p_name").alias("text"))
    return t.benchmark.select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("case_id"), "text").unionByName(cases)


@query("cyclic_cases", "WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) SELECT p_partkey AS case_id, r.item_id FROM part, n JOIN r ON r.i = p_partkey % n.n")
def _(t):
    n = t.benchmark.count()
    rows = cat.numbered(t.benchmark.select("item_id"), "item_id", "i")
    return t.part.select(F.col("p_partkey").alias("case_id"), (F.pmod("p_partkey", F.lit(n)) + 1).alias("i")).join(rows, "i").select("case_id", "item_id")


@query("reference_explode", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, turn, role FROM conversations")
def _(t):
    nested = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("annotations"))
    return nested.select("conv_id", F.posexplode("annotations").alias("pos", "a")).select("conv_id", "pos", "a.turn", "a.role")


# end to end

_EVAL = f"""{_SEARCH}, x AS (SELECT a.q AS conv_id, a.rank, a.doc AS facet_id, c.normalized_facet AS facet, lower(c.normalized_facet) AS low, lower(string_split(ok.text, '"')[1]) AS conv FROM b_all a JOIN catalog c ON c.facet_id = a.doc JOIN ok ON ok.q = a.q WHERE a.rank <= 10),
results AS (SELECT conv_id, rank, facet_id, facet, {', '.join(f'{v} AS {k}' for k, v in _RULE.items())} FROM x)"""


@query("evaluate_end_to_end", f"WITH {_EVAL} SELECT * FROM results")
def _(t):
    return plan.evaluate(t.accepted(), t.kept_catalog()).select("conv_id", "rank", "facet_id", "facet", "status", "score", "confidence", "evidence")


@query("response_metadata", f"WITH {_EVAL} SELECT conv_id, count(*) AS n_retrieved, count_if(status = 'scored') AS n_scored, count_if(status <> 'scored') AS n_abstained FROM results GROUP BY conv_id")
def _(t):
    return ev.response_metadata(plan.evaluate(t.accepted(), t.kept_catalog()))


@query("observed_totals", f"""WITH {_EVAL} SELECT 'results' AS component, m.measure, CAST(m.value AS BIGINT) AS value FROM
 (SELECT count(*) AS rows, count_if(status = 'scored') AS n_scored, count_if(status <> 'scored') AS n_abstained FROM results) UNPIVOT (value FOR measure IN (rows, n_scored, n_abstained)) m""")
def _(t):
    run = measures.Run(t.spark)
    plan.measured(run, t.accepted(), t.kept_catalog())
    return run.counts().filter("component = 'results'").select("component", "measure", "value")


@query("candidate_override", f"WITH {S.CATALOG}, {S.CONVERSATIONS}, g AS (SELECT conv_id, facet_id, normalized_facet, conversation_observable, abstention_reason, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rank FROM folded, catalog WHERE facet_id IN ('FACET_009', 'FACET_015', 'FACET_021')) SELECT conv_id, rank, facet_id, CASE WHEN conversation_observable THEN 'routed' ELSE 'not_observable' END AS status FROM g")
def _(t):
    given = t.folded().select("conv_id", F.explode(F.array(*map(F.lit, ("FACET_009", "FACET_015", "FACET_021")))).alias("facet_id"))
    catalog = t.kept_catalog()
    out = plan.evaluate(stored(t.folded()), catalog, facets=given)
    hidden = catalog.select("facet_id", "conversation_observable")
    return out.join(hidden, "facet_id").select("conv_id", "rank", "facet_id", F.when(F.col("conversation_observable"), "routed").otherwise(F.col("status")).alias("status"))


def echo_backend(system: str, user: str) -> str:
    """A stand-in for a model: scores every candidate of the prompt 3."""
    import json
    import re

    found = re.findall(r"- Facet ID: (\S+)\n  - Facet Name: (.*)\n", user)
    return json.dumps([{"facet_id": i, "facet": n, "status": "scored", "score": 3, "confidence": 0.5, "evidence": "…", "reason": "echo"} for i, n in found])


@query("mapinpandas_backend", f"WITH {_EVAL} SELECT conv_id, rank, facet_id, 'scored' AS status, 3 AS score FROM results")
def _(t):
    return plan.evaluate(t.accepted(), t.kept_catalog(), batch_size=4, backend=echo_backend).select("conv_id", "rank", "facet_id", "status", "score")


@query("nested_export", f"WITH {_EVAL} SELECT conv_id, to_json(list({{rank: rank, facet_id: facet_id, facet: facet, status: status, score: score, confidence: confidence, evidence: evidence}} ORDER BY rank))::VARCHAR AS results_json FROM results GROUP BY conv_id")
def _(t):
    return files.nested_export(plan.evaluate(t.accepted(), t.kept_catalog()).drop("reason"))


_ANNOTATED = "SELECT conv_id, facet_id, CASE conv_id % 3 WHEN 0 THEN 'scored' WHEN 1 THEN 'insufficient_evidence' ELSE 'not_observable' END AS expected_status, CASE WHEN conv_id % 3 = 0 THEN 4 END AS expected_score FROM "


@query("benchmark_report", f"WITH {_EVAL}, j AS (SELECT a.*, r.status AS predicted_status, r.score AS predicted_score FROM ({_ANNOTATED} results WHERE rank <= 3) a JOIN results r USING (conv_id, facet_id)) SELECT expected_status, predicted_status, count(*) AS n FROM j GROUP BY ALL")
def _(t):
    results = stored(plan.evaluate(t.accepted(), t.kept_catalog()))
    annotations = t.spark.sql(_ANNOTATED + "{results} WHERE rank <= 3", results=results)
    return plan.benchmark(annotations, results)["confusion"]


@query("scored_partition", f"WITH {_EVAL} SELECT conv_id, count(*)::INT AS total_candidates_retrieved, coalesce(string_agg(facet_id, ' ' ORDER BY rank) FILTER (status = 'scored'), '') AS scored, coalesce(string_agg(facet_id, ' ' ORDER BY rank) FILTER (status <> 'scored'), '') AS abstained FROM results GROUP BY conv_id")
def _(t):
    names = lambda c: F.array_join(F.transform(c, lambda r: r["facet_id"]), " ")
    return plan.responses(plan.evaluate(t.accepted(), t.kept_catalog())).select("conv_id", "total_candidates_retrieved", names("evaluated_results").alias("scored"), names("abstained_results").alias("abstained"))


# sources and sinks, each written and read again


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/lumenfold/{uuid.uuid4().hex}"


@query("catalog_files", f"WITH {S.CATALOG}, c AS (SELECT facet_id, raw_facet, normalized_facet, facet_type, conversation_observable, sensitivity, scoring_anchors, abstention_reason, quality_flag FROM catalog) SELECT 'csv' AS kind, facet_id, nullif(raw_facet, '') AS raw_facet, nullif(normalized_facet, '') AS normalized_facet, facet_type, conversation_observable, sensitivity, scoring_anchors, nullif(abstention_reason, '') AS abstention_reason, quality_flag FROM c UNION ALL SELECT 'json', * FROM c UNION ALL SELECT 'parquet', * FROM c")
def _(t):
    at = _folder(t)
    files.write_catalog(t.catalog(), at)
    read = {kind: files.read_catalog(t.spark, f"{at}/{name}") for kind, name in (("csv", "catalog_csv"), ("json", "catalog_json"), ("parquet", "catalog.parquet"))}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), "facet_id", "raw_facet", "normalized_facet", "facet_type", "conversation_observable", "sensitivity", "scoring_anchors", "abstention_reason", "quality_flag") for kind, rows in read.items()])


@query("rows_log", "SELECT doc_id, quality, toxic, 2 AS n FROM labels")
def _(t):
    at = _folder(t)
    files.write_rows(t.labels, at, ("csv",))
    files.write_rows(t.labels, at, ("csv",), mode="append")
    log = t.spark.read.option("header", True).schema(t.labels.schema).csv(f"{at}/csv")
    return log.groupBy("doc_id", "quality", "toxic").agg(F.count("*").cast("int").alias("n"))


@query("embedding_store", "SELECT doc_id, CASE WHEN e.vec_id IS NULL OR doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 'embed' ELSE 'stored' END AS side FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id")
def _(t):
    """Vectors of all texts, then of every third one after an edit; each seventh document is deleted, and all is written for another backend."""
    at, store = _folder(t), files.VectorStore
    docs = t.documents.select("doc_id", "text")
    hashed = lambda rows: rows.withColumn("text_hash", F.sha2("text", 256)).join(t.dense().select("doc_id", "vector"), "doc_id")
    files.write_embeddings(hashed(docs), at)
    files.write_embeddings(hashed(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("before "), "text"))), at)
    store(t.spark, at).delete(docs.filter("doc_id % 7 = 0").select("doc_id"))
    files.write_embeddings(hashed(docs), at, "tf")
    store(t.spark, at).compact()
    have, rest = files.embeddings(t.spark, at, docs)
    return have.select("doc_id", F.lit("stored").alias("side")).unionByName(rest.select("doc_id", F.lit("embed").alias("side")))


@query("vector_versions", """WITH w AS (SELECT vec_id AS doc_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings), v AS (SELECT 1 AS version, doc_id, s FROM w UNION ALL
SELECT 2, doc_id, CASE WHEN doc_id % 4 = 0 THEN -s ELSE s END FROM w UNION ALL SELECT 3, doc_id, CASE WHEN doc_id % 4 = 0 THEN -s ELSE s END FROM w WHERE doc_id % 5 <> 0) SELECT version, doc_id, round(s, 5) + 0.0 AS total FROM v""")
def _(t):
    """Three versions of a store: all vectors, every fourth one turned round, every fifth one deleted; each is read as it was."""
    store = files.VectorStore(t.spark, _folder(t))
    rows = t.vectors().select("doc_id", F.lit("h").alias("text_hash"), F.col("vector").cast("array<double>").alias("vector"))
    store.write(rows)
    store.write(rows.filter("doc_id % 4 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    store.delete(rows.filter("doc_id % 5 = 0").select("doc_id"))
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)
    return reduce(DataFrame.unionByName, [store.read(version=v).select(F.lit(v).alias("version"), "doc_id", total.alias("total")) for v in (1, 2, 3)])
