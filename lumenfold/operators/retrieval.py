"""Lexical and dense ranking of documents for queries, and ways to fuse rankings.

Rankings are tables (query_id, doc_id, score, rank) with ranks from 1 and explicit tie orders. Scores are rounded before
they rank, so that the order of a sum's terms doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lumenfold.functions import text
from lumenfold.operators import lsa, postings, streamed
from lumenfold.session import spread, stored

K1, B, IDF_FLOOR = 1.5, 0.75, 0.01
RRF_K = 60
MISSING = 999
DIGITS = 9
MAX_QUERY_BYTES = 256 << 20
MAX_NORMS = 4_000_000  # rows of a document's id and length that may be broadcast; beyond, they are joined by a shuffle


def ranked(scores: DataFrame, order: list[Column], top_k: int | None = None, to: str = "rank", by: str = "query_id") -> DataFrame:
    out = scores.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out.filter(F.col(to) <= top_k) if top_k else out


def lexical_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, doc_pos, terms, n_terms. Documents that have their terms already (``index``) are taken as they are."""
    if "terms" in docs.columns and "n_terms" in docs.columns:
        return docs.select("doc_id", "doc_pos", "terms", "n_terms")
    return docs.select("doc_id", "doc_pos", text.terms(F.col(text_col)).alias("terms")).withColumn("n_terms", F.size("terms"))


def index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' terms as a table of the shared folder: texts are tokenized once, whatever is asked of them after."""
    return stored(lexical_terms(spread(docs), text_col))


def idf(docs: DataFrame, text_col: str = "text", floor: float | None = IDF_FLOOR) -> DataFrame:
    """token, df, idf of every term of the documents."""
    terms = lexical_terms(docs, text_col)
    n = terms.agg(F.count("*").alias("n"))
    df = terms.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return _with_idf(df.join(F.broadcast(n)), floor).select("token", "df", "idf")  # n is one row


def _with_idf(df: DataFrame, floor: float | None) -> DataFrame:
    value = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return df.withColumn("idf", F.greatest(value, F.lit(floor)) if floor is not None else value)


def _length_share(stats: str = "avg_len", k1: float = K1, b: float = B) -> Column:
    return (k1 + 1) / F.greatest(1 + k1 * (1 - b + b * F.col("n_terms") / F.col(stats)), F.lit(1e-6))


class Lexical:
    """Scores of the documents that stream past a stated set of queries. A score is the sum of the shared terms' parts, each the
    term's idf times a share that falls with the document's length; documents without a shared term score 0."""

    def __init__(self, docs: DataFrame, queries: DataFrame, text_col: str = "text", k1: float = K1, b: float = B, floor: float | None = IDF_FLOOR):
        self.docs = lexical_terms(docs if "terms" in docs.columns else index(docs, text_col))
        self.kinds = queries.schema["query_id"].dataType, self.docs.schema["doc_id"].dataType
        asked = stored(queries.select("query_id", F.explode_outer(text.terms(F.col("text"))).alias("token")))
        rows = _small(asked, 96).collect()
        tokens = asked.select("token").filter("token IS NOT NULL").distinct()
        stats = self.docs.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("n_terms"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))
        df = self.docs.select(F.explode("terms").alias("token")).join(F.broadcast(tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))  # the stated queries' terms
        idfs = {r.token: r.idf for r in _with_idf(df.join(F.broadcast(stats)), floor).collect()}
        self.avg_len, self.k1, self.b = stats.first()["avg_len"], k1, b
        pairs = sorted({(r.query_id, r.token, idfs[r.token]) for r in rows if r.token in idfs}, key=lambda p: p[1])
        self.asked = streamed.asked(list(dict.fromkeys(r.query_id for r in rows)), pairs)

    def map(self, use: Callable, *more: tuple[str, object]) -> DataFrame:
        """What use makes of the scores: query_id, doc_id and the columns named in more."""
        shared, k1, b, avg_len = self.docs.sparkSession.sparkContext.broadcast(self.asked), self.k1, self.b, self.avg_len
        schema = StructType().add("query_id", self.kinds[0]).add("doc_id", self.kinds[1])
        for name, kind in more:
            schema = schema.add(name, kind)

        def score(batches: Iterator[pa.RecordBatch]) -> streamed.Slices:
            asked = shared.value
            tokens = pa.array(asked.tokens, pa.string())
            for batch in batches:
                for at in range(0, len(batch), asked.rows):
                    part = batch.slice(at, asked.rows)
                    doc, token = streamed.hits(part.column(2), tokens)
                    length = np.maximum(1 + k1 * (1 - b + b * part.column(3).to_numpy() / avg_len), 1e-6)
                    s = streamed.summed(asked, doc, token, (k1 + 1) / length[doc], len(part))
                    yield np.round(s, DIGITS), part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()

        docs = self.docs.select("doc_id", F.col("doc_pos").cast("long").alias("doc_pos"), "terms", "n_terms")
        return docs.mapInArrow(streamed.run(score, use, to_arrow_schema(schema)), schema)

    def scores(self, top_k: int | None = None) -> DataFrame:
        """query_id, doc_id, doc_pos, score of all pairs, or of each task's best top_k of a query."""
        names = self.asked.names
        return self.map(streamed.best_of(names, top_k) if top_k else streamed.all_of(names), ("doc_pos", LongType()), ("score", DoubleType()))

    def of(self, wanted: DataFrame) -> DataFrame:
        """query_id, doc_id, doc_pos, score of the wanted pairs, a stated set."""
        rows = _small(wanted, 96).select("query_id", "doc_id").distinct().collect()
        return self.map(streamed.those_of(self.asked.names, _of_query(rows, "doc_id")), ("doc_pos", LongType()), ("score", DoubleType()))

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """query_id, doc_id, rank in the list of all documents for the wanted pairs, by counting what stands before each."""
        found = _of_query(self.of(wanted).collect(), "doc_id", "score", "doc_pos")  # at most the wanted pairs
        counts = self.map(streamed.counts_of(self.asked.names, found, before), ("n", LongType()))
        return counts.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).cast("int").alias("rank"))


def bm25_scores(docs: DataFrame, queries: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """query_id, doc_id, doc_pos, score of the pairs that share a term."""
    return Lexical(docs, queries, text_col, **how).scores().filter("score > 0")


def bm25_top(docs: DataFrame | postings.Index, queries: DataFrame, top_k: int, text_col: str = "text", k1: float = K1, b: float = B, floor: float | None = IDF_FLOOR) -> DataFrame:
    """The best top_k documents of each query (a stated set), as in a list of all documents, in which those without a shared
    term follow with score 0 in the documents' order.

    Documents stream past the queries, and of each task the best top_k of a query go on, so what is shuffled doesn't grow
    with the pairs. ``bm25_many`` is for more queries than a worker should hold. A kept index (``postings.build``) is
    searched with skipping instead.
    """
    if isinstance(docs, postings.Index):
        return postings.search(docs, queries, top_k, k1, b, floor).found
    return ranked(Lexical(docs, queries, text_col, k1, b, floor).scores(top_k), [F.desc("score"), F.col("doc_pos")], top_k)


def bm25_many(docs: DataFrame, queries: DataFrame, top_k: int, text_col: str = "text", k1: float = K1, b: float = B, floor: float | None = IDF_FLOOR) -> DataFrame:
    """The lists of ``bm25_top`` for any number of queries, over documents of which many look alike to them.

    Documents with the same number of terms and the same terms among those that queries ask for score the same for every
    query, so only the first top_k of each such pattern can come into a list, and of a query's patterns only the top_k
    best. Patterns are scored, not documents: the pairs grow with the queries and the different patterns. Terms that
    every document has are added by one number a query, as in ``bm25_top``.
    """
    docs = docs if "terms" in docs.columns else index(docs, text_col)
    terms = lexical_terms(docs, text_col)
    stats = terms.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("n_terms"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))
    asked = queries.select("query_id", F.explode(text.terms(F.col("text"))).alias("token"))
    df = terms.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(asked.select("token").distinct(), "token", "left_semi")
    vocabulary = stored(_with_idf(df.join(F.broadcast(stats)), floor).select("token", "idf", "avg_len", (F.col("df") == F.col("n")).alias("everywhere")))
    known = stored(asked.join(vocabulary, "token"))
    share = _length_share(k1=k1, b=b)

    telling = vocabulary.filter("NOT everywhere").select("token")
    hits = terms.select("doc_id", "doc_pos", "n_terms", F.explode("terms").alias("token")).join(telling, "token", "left_semi")
    own = hits.groupBy("doc_id", "doc_pos", "n_terms").agg(F.array_sort(F.collect_list("token")).alias("own"))  # at most a document's terms
    place = F.row_number().over(Window.partitionBy("n_terms", "own").orderBy("doc_pos"))
    members = stored(own.withColumn("place", place).filter(F.col("place") <= top_k))
    patterns = members.filter("place = 1").select(F.col("doc_id").alias("pattern"), F.col("doc_pos").alias("first"), "n_terms", "own")
    weighed = patterns.select("pattern", "first", "n_terms", F.explode("own").alias("token")).join(known.filter("NOT everywhere"), "token")
    summed = weighed.groupBy("query_id", "pattern", "first", "n_terms", "avg_len").agg(F.sum(F.col("idf") * share).alias("s"))

    common = known.filter("everywhere").groupBy("query_id").agg(F.sum("idf").alias("u"))
    every = stored(queries.select("query_id").distinct().join(common, "query_id", "left").withColumn("u", F.coalesce("u", F.lit(0.0))))
    scored = summed.join(every, "query_id").select("query_id", "pattern", "first", F.round(F.col("s") + F.col("u") * share, DIGITS).alias("score"))
    best = ranked(scored, [F.desc("score"), F.col("first")], top_k).drop("rank", "first")
    of = members.join(patterns.select("pattern", "n_terms", "own"), ["n_terms", "own"]).select("pattern", "doc_id", "doc_pos")
    found = best.join(of, "pattern").select("query_id", "doc_id", "doc_pos", "score")

    both = found.unionByName(_without_telling(terms, every, stats, top_k, share)).groupBy("query_id", "doc_id", "doc_pos").agg(F.max("score").alias("score"))
    return ranked(both, [F.desc("score"), F.col("doc_pos")], top_k)


def _without_telling(terms: DataFrame, every: DataFrame, stats: DataFrame, top_k: int, share: Column) -> DataFrame:
    """What may come into a query's list without a term that tells documents apart: the top_k shortest where the query has a
    term that all documents have (u > 0), else the first."""
    sized = terms.select("doc_id", "doc_pos", "n_terms")
    short = sized.orderBy("n_terms", "doc_pos").limit(top_k).withColumn("for_common", F.lit(True))
    first = sized.orderBy("doc_pos").limit(top_k).withColumn("for_common", F.lit(False))
    few = short.unionByName(first).join(F.broadcast(stats.select("avg_len")))
    return every.join(F.broadcast(few), (F.col("u") > 0) == F.col("for_common")).select("query_id", "doc_id", "doc_pos", F.round(F.col("u") * share, DIGITS).alias("score"))  # top_k rows a query


def bm25_all(docs: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """The rank of every document for every query of a stated set, those without a shared term last in the documents' order."""
    return ranked(Lexical(docs, queries, **how).scores(), [F.desc("score"), F.col("doc_pos")])


def term_vectors(docs: DataFrame, inverse: bool = False, statistics_of: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight: L2-normalised counts of words, or smoothed tf-idf of words of two characters and pairs."""
    words = text.word_tokens(F.col("text"))
    if inverse:
        words = F.filter(words, lambda t: F.length(t) >= 2)
        words = F.concat(words, text.bigrams(words))
    counts = docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("weight"))
    if inverse:
        base = statistics_of if statistics_of is not None else docs
        base_words = F.filter(text.word_tokens(F.col("text")), lambda t: F.length(t) >= 2)
        seen = base.select("doc_id", F.explode(F.array_distinct(F.concat(base_words, text.bigrams(base_words)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        n = base.agg(F.count("*").alias("n"))
        idfs = seen.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
        counts = counts.join(idfs, "term").select("doc_id", "term", (F.col("weight") * F.col("idf")).alias("weight"))
    norm = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return counts.join(norm, "doc_id").select("doc_id", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def _term_list(inverse: bool) -> Column:
    words = text.word_tokens(F.col("text"))
    if not inverse:
        return words
    words = F.filter(words, lambda t: F.length(t) >= 2)
    return F.transform(F.array(words), lambda w: F.concat(w, text.bigrams(w)))[0]


def term_norms(lists: DataFrame, n: int) -> DataFrame:
    """doc_id, norm: the lengths of the smoothed tf-idf vectors. lists: doc_id, terms, repeats kept.

    A document's terms are counted in its task, and of each only the 64-bit hash is shuffled, once. Two terms of one hash
    would share a document frequency, in these lengths alone; among 10 ** 9 different terms there is such a pair once in 37 times.
    """
    schema = StructType([lists.schema["doc_id"], StructField("h", LongType()), StructField("c", LongType())])
    made = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                h, c = np.unique(batch.column(1)[i].values.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(h), i))), pa.array(h), pa.array(c)], schema=made)

    hashed = lists.select("doc_id", F.transform("terms", lambda t: F.xxhash64(t)).alias("h"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("h"))  # a row a document that has the term
    counts = hashed.mapInArrow(count, schema).withColumn("idf", F.log(F.lit(1.0 + n) / (1 + seen)) + 1)
    return counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("c") * F.col("idf") * F.col("c") * F.col("idf"))).alias("norm"))


class Terms:
    """Cosine of sparse term vectors of the documents that stream past a stated set of queries. Query terms outside the
    documents' vocabulary don't count; pairs without a shared term have no score.

    Documents are tokenized once into a table of the shared folder, whatever is asked of them. Without weights a
    document's length comes from its own terms, in the task that has them.
    """

    def __init__(self, docs: DataFrame, inverse: bool = False):
        self.inverse = inverse
        lists = stored(spread(docs.select("doc_id", "doc_pos", "text")).select("doc_id", "doc_pos", _term_list(inverse).alias("terms")))
        self.docs = lists.withColumn("norm", F.lit(0.0))
        if inverse:
            self.n = lists.count()
            norms = stored(term_norms(lists, self.n))
            self.docs = lists.join(F.broadcast(norms) if self.n <= MAX_NORMS else norms, "doc_id").select("doc_id", "doc_pos", "terms", "norm")

    def top(self, queries: DataFrame, top_k: int) -> DataFrame:
        asked = stored(queries.select("query_id", F.explode_outer(_term_list(self.inverse)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("c")))
        tokens = F.broadcast(asked.select("token").filter("token IS NOT NULL").distinct())  # the stated queries' terms
        df = self.docs.select(F.explode(F.array_distinct("terms")).alias("token")).join(tokens, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
        df = {r.token: r.df for r in df.collect()}
        weight = {t: float(np.log((1 + self.n) / (1 + v)) + 1) if self.inverse else 1.0 for t, v in df.items()}
        rows = _small(asked, 96).collect()
        own: dict = {}
        for r in rows:
            if r.token in weight:
                own.setdefault(r.query_id, []).append((r.token, r.c * weight[r.token]))
        length = {q: float(np.sqrt(sum(w * w for _, w in sorted(held)))) for q, held in own.items()}
        # A term's idf counts twice, as it is in the query's and in the document's vector.
        pairs = [(q, t, w * weight[t] / length[q]) for q, held in own.items() for t, w in held]
        shared = self.docs.sparkSession.sparkContext.broadcast(streamed.asked(list(dict.fromkeys(r.query_id for r in rows)), pairs))
        schema = StructType().add("query_id", queries.schema["query_id"].dataType).add("doc_id", self.docs.schema["doc_id"].dataType).add("doc_pos", LongType()).add("score", DoubleType())
        weighted = self.inverse

        def score(batches: Iterator[pa.RecordBatch]) -> streamed.Slices:
            asked = shared.value
            tokens = pa.array(asked.tokens, pa.string())
            for batch in batches:
                for at in range(0, len(batch), asked.rows):
                    part = batch.slice(at, asked.rows)
                    norm = part.column(3).to_numpy() if weighted else streamed.lengths(part.column(2))
                    doc, token, c = streamed.counted(*streamed.hits(part.column(2), tokens), len(asked.tokens))
                    s = np.round(streamed.summed(asked, doc, token, c / norm[doc], len(part)), DIGITS)
                    none = streamed.summed(asked, doc, token, np.ones(len(doc)), len(part)) == 0  # weights are positive
                    yield np.where(none, -np.inf, s), part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()

        docs = self.docs.select("doc_id", F.col("doc_pos").cast("long").alias("doc_pos"), "terms", "norm")
        best = docs.mapInArrow(streamed.run(score, streamed.best_of(shared.value.names, top_k), to_arrow_schema(schema)), schema)
        return ranked(best, [F.desc("score"), F.col("doc_pos")], top_k)


def term_cosine(docs: DataFrame, queries: DataFrame, top_k: int, inverse: bool = False) -> DataFrame:
    """The best documents of each query by the cosine of their term vectors, of those that share a term."""
    return Terms(docs, inverse).top(queries, top_k)


def _small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """Rows that are to go to the driver and all workers, once their count says that they may."""
    n = rows.count()
    if n * row_bytes > MAX_QUERY_BYTES:
        raise ValueError(f"{n} rows of some {row_bytes} bytes; give them in blocks of at most {MAX_QUERY_BYTES} bytes")
    return rows


Use = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _dense_map(docs: DataFrame, queries: DataFrame, use: Use, schema: str, normalise: bool) -> DataFrame:
    """Documents stream past the queries in Arrow batches, one matrix product each. use gets the queries' ids, the scores
    [queries, documents], the documents' ids and places, and returns rows of schema as columns."""
    spark = docs.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v")).filter("v is not null")
    widest = asked.agg(F.max(F.size("v"))).first()[0]
    if not widest:
        return spark.createDataFrame([], schema)
    rows = _small(asked, 8 * widest + 64).collect()
    q = np.array([r.v for r in rows], np.float64)
    if normalise:
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.where(norm > 0, q / np.where(norm > 0, norm, 1), 0)
    shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            if normalise:
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm > 0, norm, 1e-9)
            made = use(names, np.round(q @ x.T, DIGITS) + 0.0, ids, pos)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], [c.split()[0] for c in schema.split(", ")])

    vectors = docs.select(F.col("doc_id").cast("long"), F.col("doc_pos").cast("long"), F.col("vector").cast("array<double>").alias("v")).filter("v is not null")
    return vectors.mapInArrow(run, schema)


SCORED = "query_id long, doc_id long, doc_pos long, score double"


def dense_scores(docs: DataFrame, queries: DataFrame, top_k: int | None = None, normalise: bool = True) -> DataFrame:
    """query_id, doc_id, doc_pos, score: cosine (or dot product) of every query with every document's vector.

    The queries, a stated set of at most ``MAX_QUERY_BYTES``, go to all workers; with top_k only a batch's best go on.
    """

    def best(names: np.ndarray, s: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple:
        if top_k and top_k < len(ids):
            order = np.lexsort((np.broadcast_to(pos, s.shape), -s), axis=1)[:, :top_k]
        else:
            order = np.broadcast_to(np.arange(len(ids)), s.shape)
        who, what = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
        return names[who], ids[what], pos[what], s[who, what]

    return _dense_map(docs, queries, best, SCORED, normalise)


def before(scores: np.ndarray, pos: np.ndarray, score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the rows (scores, pos) stand before each (score, at) in a list of falling scores and then rising places."""
    order = np.lexsort((pos, -scores))
    low, pos = -scores[order], pos[order]
    first, last = np.searchsorted(low, -score, "left"), np.searchsorted(low, -score, "right")
    return np.array([f + np.searchsorted(pos[f:e], p) for f, e, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)], np.int64)


def _of_query(rows: list, *columns: str) -> dict[int, tuple]:
    """Arrays of the columns for each query_id."""
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(tuple(r[c] for c in columns))
    return {q: tuple(np.array(c) for c in zip(*held, strict=True)) for q, held in out.items()}


def dense_ranks(docs: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, doc_id, rank in the list of all documents for the wanted pairs (a stated set), by counting what stands
    before each: two passes over the vectors, and no list of all pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(_of_query(_small(wanted, 64).select("query_id", "doc_id").collect(), "doc_id"))

    def find(names: np.ndarray, s: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple:
        hits = [np.flatnonzero(np.isin(ids, shared.value[n][0])) if n in shared.value else np.zeros(0, np.int64) for n in names.tolist()]
        who, what = np.repeat(np.arange(len(names)), [len(h) for h in hits]), np.concatenate(hits)
        return names[who], ids[what], pos[what], s[who, what]

    rows = _dense_map(docs, queries, find, SCORED, True).collect()  # at most the wanted pairs
    found = docs.sparkSession.sparkContext.broadcast(_of_query(rows, "doc_id", "score", "doc_pos"))

    def count(names: np.ndarray, s: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple:
        out = [(np.full(len(w[0]), n), w[0], before(s[k], pos, w[1], w[2])) for k, n in enumerate(names.tolist()) if (w := found.value.get(n)) is not None]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    counts = _dense_map(docs, queries, count, "query_id long, doc_id long, n long", True)
    return counts.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).cast("int").alias("rank"))


def rrf_complete(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Fusion of the lexical and the dense list of all documents, without making them: a document outside the first
    59 + 2 top_k of both can't be among the best, and of those inside the exact rank in the other list is counted."""
    depth = RRF_K + 2 * top_k
    lexical = Lexical(docs, queries)
    first = ranked(lexical.scores(depth), [F.desc("score"), F.col("doc_pos")], depth)
    lists = [stored(first.select("query_id", "doc_id", "rank")), stored(dense_top(vectors, queries, depth).select("query_id", "doc_id", "rank"))]
    pairs = stored(lists[0].select("query_id", "doc_id").unionByName(lists[1].select("query_id", "doc_id")).distinct())
    return rrf([lexical.ranks(pairs), dense_ranks(vectors, queries, pairs)], top_k)


def containing(docs: DataFrame, indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents that hold a query's text literally.

    A word inside the text (with other characters on both sides) stands whole in such a document, so those with the
    query's rarest one are tried; queries without such a word, a stated set, are held against all documents.
    """
    inner = F.regexp_replace("text", r"^[\p{L}\p{N}_]+|[\p{L}\p{N}_]+$", "")
    words = queries.filter("text IS NOT NULL").select("query_id", F.col("text").alias("want"), F.array_distinct(text.whole_words(inner)).alias("words"))
    each = words.select("query_id", "want", F.explode("words").alias("token"))
    held = indexed.select("doc_id", F.explode("terms").alias("token")).join(F.broadcast(each.select("token").distinct()), "token", "left_semi")  # the stated queries' words
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    rarest = each.join(df, "token", "left").groupBy("query_id", "want").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    pairs = stored(held.join(F.broadcast(rarest), "token").select("query_id", "want", "doc_id"))  # few, so that the join needn't shuffle the texts
    tried = pairs.join(docs.select("doc_id", "text"), "doc_id")
    rest = _small(words.filter("size(words) = 0").select("query_id", "want"), 1024)
    every = docs.select("doc_id", "text").join(F.broadcast(rest), F.col("text").contains(F.col("want")))
    return tried.filter(F.col("text").contains(F.col("want"))).select("query_id", "doc_id").unionByName(every.select("query_id", "doc_id"))


def dense_top(docs: DataFrame, queries: DataFrame, top_k: int | None, normalise: bool = True) -> DataFrame:
    return ranked(dense_scores(docs, queries, top_k, normalise), [F.desc("score"), F.col("doc_pos")], top_k)


def rrf(lists: list[DataFrame], top_k: int | None = None, k: int = RRF_K, pool: int | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists (each query_id, doc_id, rank), cut to their first pool where given.

    Ties go by the rank in the first list, then the next. Returns query_id, doc_id, rank_1, rank_2, ..., score, rank.
    """
    tagged = [x.filter(F.col("rank") <= pool) if pool else x for x in lists]
    union = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", F.lit(i + 1).alias("list"), "rank") for i, x in enumerate(tagged)])
    ranks = [F.max(F.when(F.col("list") == i + 1, F.col("rank"))).alias(f"rank_{i + 1}") for i in range(len(lists))]
    fused = union.groupBy("query_id", "doc_id").agg(*ranks, F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    return ranked(fused, [F.desc("score"), *(F.asc_nulls_last(f"rank_{i + 1}") for i in range(len(lists))), F.col("doc_id")], top_k)


def model_vectors(docs: DataFrame, load: Callable[[], Callable[[list[str]], object]], id_column: str = "doc_id", batch: int = 64) -> DataFrame:
    """id_column, vector: load() gives a function from texts to rows of numbers; it is called once a task, and the
    function for each batch of texts. A null text is embedded as an empty one."""
    kind = dict(docs.dtypes)[id_column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for frame in frames:
            encode = encode or load()
            texts = [t or "" for t in frame["text"]]
            rows = [v for k in range(0, len(texts), batch) for v in np.asarray(encode(texts[k : k + batch]), dtype=float)]
            yield pd.DataFrame({id_column: frame[id_column], "vector": rows})

    return docs.select(id_column, "text").mapInPandas(run, f"{id_column} {kind}, vector array<double>")


BACKENDS = ("model", "lsa", "tfidf", "tf")


def semantic_top(docs: DataFrame, queries: DataFrame, top_k: int, backend: str = "tfidf", load: Callable | None = None) -> DataFrame:
    """The semantic list by the backend named: vectors of a loaded model or of a decomposition of the documents' own
    terms, or cosine over weighted or plain term counts.
    The choice is the caller's; a model that fails to load fails the query and doesn't become another backend."""
    if backend not in BACKENDS or (backend == "model") != (load is not None):
        raise ValueError(f"backend is one of {BACKENDS}, with a loader for model alone")
    if backend == "lsa":
        return lsa_top(docs, queries, top_k)
    if backend != "model":
        return term_cosine(docs, queries, top_k, inverse=backend == "tfidf")
    placed = model_vectors(docs, load).join(docs.select("doc_id", "doc_pos"), "doc_id")
    return dense_top(placed, model_vectors(queries, load, "query_id"), top_k)


def lsa_top(docs: DataFrame, queries: DataFrame, top_k: int, **how) -> DataFrame:
    """The best documents by the cosine of vectors that are fitted on the documents (``lsa.fit``)."""
    model = lsa.fit(docs, **how)
    placed = model.docs.join(docs.select("doc_id", "doc_pos"), "doc_id")
    return dense_top(placed, lsa.embedded(model, queries), top_k)


def tri_fusion(lexical: DataFrame, docs: DataFrame, queries: DataFrame, expanded: DataFrame, top_k: int, pool: int = 100, backend: str = "tfidf", load: Callable | None = None) -> DataFrame:
    """Fusion of a lexical list of the queries with the semantic lists of the queries and of the expanded queries."""
    if backend in ("tf", "tfidf") and load is None:
        terms = Terms(docs, backend == "tfidf")
        return rrf([lexical, *(terms.top(asked, pool) for asked in (queries, expanded))], top_k, pool=pool)
    return rrf([lexical, *(semantic_top(docs, asked, pool, backend, load) for asked in (queries, expanded))], top_k, pool=pool)


def tiered_union(lists: list[DataFrame], each: int = 10, cap: int = 20) -> DataFrame:
    """The first ``each`` of every list in turn, each document once, at most cap."""
    union = reduce(DataFrame.unionByName, [x.filter(F.col("rank") <= each).select("query_id", "doc_id", F.lit(i).alias("tier"), "rank") for i, x in enumerate(lists)])
    first = union.groupBy("query_id", "doc_id").agg(F.min(F.struct("tier", "rank")).alias("at"))
    return ranked(first.select("query_id", "doc_id", F.col("at.tier").alias("tier"), F.col("at.rank").alias("tier_rank")), [F.col("tier"), F.col("tier_rank")], cap)


def include_target(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Diagnostic: candidates with each query's target added last where it is missing. It makes recall meaningless."""
    missing = targets.select("query_id", "doc_id").join(candidates, ["query_id", "doc_id"], "left_anti")
    last = candidates.groupBy("query_id").agg(F.max("rank").alias("last"))
    added = missing.join(last, "query_id", "left").select("query_id", "doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("rank"))
    return candidates.select("query_id", "doc_id", "rank").unionByName(added)


def above_threshold(fused: DataFrame, threshold: float | None) -> DataFrame:
    """Drops rows whose dense score is under the threshold and that share no term; None drops nothing."""
    return fused if threshold is None else fused.filter(~((F.col("dense_score") < threshold) & (F.col("bm25_score") <= 0)))


def rerank_pool(top_k: int, on: bool, pool: int = 30) -> int:
    return max(top_k, pool) if on else top_k


def token_overlap(query: Column, doc: Column) -> Column:
    """A deterministic relevance score: shared terms over the query's terms."""
    q = text.terms(query)
    return F.round(F.size(F.array_intersect(q, text.terms(doc))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] | None = token_overlap, top_k: int = 10) -> DataFrame:
    """candidates: query_id, doc_id, rank, query_text, doc_text. Ordered by the scorer, ties as before; None keeps the order."""
    if scorer is None:
        return candidates.withColumn("reranker_score", F.lit(None).cast("double")).withColumn("new_rank", F.col("rank")).filter(F.col("rank") <= top_k)
    scored = candidates.withColumn("reranker_score", scorer(F.col("query_text"), F.col("doc_text")))
    return ranked(scored, [F.desc("reranker_score"), F.col("rank")], top_k, "new_rank")


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], object]]) -> Callable[[Column, Column], Column]:
    """A scorer for rerank: load() gives a function from queries and documents to scores, once a task."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for asked, docs in pairs:
            yield pd.Series(np.asarray(model(asked.fillna("").tolist(), docs.fillna("").tolist()), dtype=float))

    return score


def target_rank(candidates: DataFrame, targets: DataFrame, missing: int = MISSING) -> DataFrame:
    """query_id, doc_id, target_rank of each target; missing where it isn't among the candidates."""
    return targets.select("query_id", "doc_id").join(candidates.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id", "doc_id").agg(F.coalesce(F.min("rank"), F.lit(missing)).alias("target_rank"))


def pivot_top(candidates: DataFrame, n: int = 10, value: str = "doc_id") -> DataFrame:
    """One row a query with top1 ... topn, empty where there are fewer."""
    at = [F.coalesce(F.max(F.when(F.col("rank") == i, F.col(value).cast("string"))), F.lit("")).alias(f"top{i}") for i in range(1, n + 1)]
    return candidates.filter(F.col("rank") <= n).groupBy("query_id").agg(*at)
