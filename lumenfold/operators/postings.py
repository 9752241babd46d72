"""A kept inverted index for lexical ranking: postings in blocks with their least length, read with skipping.

Documents are ordered by their texts' lengths within each part of their table and cut into ranges of ``RANGE``; a block is what a
range has of one term: the places in the range, a byte each, and the least number of terms among them. A task makes the
blocks of its documents where it tokenizes them, so nothing is shuffled to build the index. A document's score is
the sum of its shared terms' idf times a share that falls with its length, so sum(idf) times the share of the least length
bounds what any document of a range can score for a query, and ranges of like lengths make that bound tight.

A search takes the blocks of the terms that its queries (a stated set) ask for and brings those of a range together. Three
passes go over the ranges, each made in numpy where the range's blocks are, so that pairs of queries and documents are never
rows. From the blocks' counts and lengths alone the first bounds every range for every query; the second scores each
query's ``FIRST`` best ranges, and their k-th best score is the threshold. In a range whose bound reaches it, the terms of the
least idf that can't reach it together are optional: the third unpacks the others' blocks, and the optional ones where
a document could still reach the threshold with all of them. What isn't unpacked holds no document of the list, so the list
is that of a full scan. A task's best k of a query go on.

The index is a folder of two tables (blocks, stats) and is opened again by any later session.
What can be skipped depends on the documents: long queries whose k-th best document has few of their terms leave little (README).
Null and empty texts are documents without terms; equal scores go by doc_pos; an empty index or a query without a term
gives the first documents with score 0, as the list of all documents has them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lumenfold.functions import text
from lumenfold.operators import streamed
from lumenfold.session import shared_dir, spread, stored

RANGE = 256  # a power of two up to 2 ** 31
FIRST = 3
K1, B, IDF_FLOOR, DIGITS = 1.5, 0.75, 0.01, 9
SLACK = 1e-8  # the bound's and the scores' sums differ by their rounding
MAX_ASKED = 4_000_000  # terms of a stated set of queries


@dataclass(frozen=True)
class Index:
    """blocks: range, token, n, least, places, docs (array of doc_id, doc_pos, n_terms, of a range's row without a token alone);
    stats: n, avg_len (one row)."""

    blocks: DataFrame
    stats: DataFrame
    path: str

    @property
    def docs(self) -> DataFrame:
        """doc_id, doc_pos, n_terms."""
        return self.blocks.filter("token IS NULL").selectExpr("inline(docs)")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each range (the first column), which follow each other."""
    now, held = None, []
    for batch in batches:
        of = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if of[s] != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(of[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def build(docs: DataFrame, path: str | None = None, text_col: str = "text") -> Index:
    """docs: doc_id, doc_pos, text. Kept below path, or in the shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/lumenfold/postings-{uuid.uuid4().hex}"
    ordered = spread(docs).select("doc_id", "doc_pos", F.col(text_col).alias("text")).sortWithinPartitions(F.length("text"), "doc_pos").withColumn("__n", F.monotonically_increasing_id())
    bits, width = RANGE.bit_length() - 1, np.uint8 if RANGE <= 256 else np.int32
    each = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("doc_pos", docs.schema["doc_pos"].dataType), StructField("n_terms", IntegerType())])
    schema = StructType.fromDDL("range long, token string, n int, least int, places binary").add("docs", ArrayType(each))
    arrow = to_arrow_schema(schema)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_range(batches):
            ids, pos, terms = (rows.column(k).combine_chunks() for k in (1, 2, 3))
            n_terms = np.asarray(pc.fill_null(pc.list_value_length(terms), 0)).astype(np.int32)
            code = terms.flatten().dictionary_encode()
            token, doc = np.asarray(code.indices), np.repeat(np.arange(len(rows)), n_terms)
            order = np.argsort(token, kind="stable")
            doc, n = doc[order], np.bincount(token, minlength=len(code.dictionary)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n)])
            least = np.minimum.reduceat(n_terms[doc], ends[:-1]) if len(n) else n
            places = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * width().itemsize).astype(np.int32)), pa.py_buffer(doc.astype(width))])
            own = pa.StructArray.from_arrays([ids, pos, pa.array(n_terms)], fields=list(arrow.field("docs").type.value_type))
            head = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), own)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.array([len(rows)], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), head.cast(arrow.field("docs").type)], schema=arrow)
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), code.dictionary, pa.array(n), pa.array(least), places, pa.nulls(len(n), arrow.field("docs").type)], schema=arrow)

    ordered.select(F.shiftright("__n", bits).alias("range"), "doc_id", "doc_pos", text.terms(F.col("text")).alias("terms")).mapInArrow(invert, schema).write.parquet(f"{path}/blocks")
    heads = spark.read.schema(schema).parquet(f"{path}/blocks").filter("token IS NULL").selectExpr("inline(docs)")
    heads.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("n_terms"), F.lit(0.0)), F.lit(1.0)).alias("avg_len")).write.parquet(f"{path}/stats")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "stats")), path)


@dataclass(frozen=True)
class Search:
    """found: query_id, doc_id, doc_pos, score, rank; of the blocks that hold a query's term (a block for each query that
    asks for it): total, and read, those that were unpacked."""

    found: DataFrame
    total: DataFrame
    read: DataFrame


@dataclass(frozen=True)
class Weighing:
    asked: streamed.Asked
    avg_len: float
    k1: float
    b: float

    def share(self, n_terms: np.ndarray) -> np.ndarray:
        return (self.k1 + 1) / np.maximum(1 + self.k1 * (1 - self.b + self.b * n_terms / self.avg_len), 1e-6)


class Range:
    """A range's documents and the pairs (who, weight, block) of queries and blocks with their terms, ordered by the terms."""

    def __init__(self, rows: pa.Table, tokens: pa.Array, w: Weighing):
        head = rows.column(5)[0].values
        self.ids, self.pos, self.n_terms = (head.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        token = np.asarray(pc.index_in(rows.column(1).slice(1).combine_chunks(), value_set=tokens)).astype(np.int64)
        self.n, self.least = (np.asarray(rows.column(k).slice(1)).astype(np.int64) for k in (2, 3))
        self.raw, self.starts = rows.column(4).slice(1), np.cumsum(self.n) - self.n
        self.w, self.queries, counts = w, len(w.asked.names), w.asked.start[token + 1] - w.asked.start[token]
        at = np.repeat(w.asked.start[token] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.block, self.who, self.weight = np.repeat(np.arange(len(token)), counts), w.asked.who[at], w.asked.weight[at]
        self.gain, self.read, self.places = np.maximum(self.weight, 0.0), 0, None

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the greatest share, and the most that a document can score; -inf where the range has no term of it."""
        top = np.full(self.queries, -np.inf)
        np.maximum.at(top, self.who, self.w.share(self.least)[self.block])
        there = top > -np.inf
        return top, np.where(there, np.bincount(self.who, self.gain, self.queries) * np.where(there, top, 0.0), -np.inf)

    def sums(self, pairs: np.ndarray) -> np.ndarray:
        """[queries, documents]: the weights' sums of these pairs, whose blocks are unpacked."""
        if self.places is None:
            raw = b"".join(self.raw.to_pylist())
            self.places = np.frombuffer(raw, np.uint8 if len(raw) == self.n.sum() else np.int32).astype(np.int64)
        out, parts = np.zeros((self.queries, len(self.ids))), np.array_split(np.arange(self.queries), max(1, min(self.queries, -(-int(self.n[self.block[pairs]].sum()) // streamed.ADDS))))
        for part in parts:
            low = part[0] if len(part) else 0
            own = pairs & (self.who >= low) & (self.who < low + len(part))
            block, cells = self.block[own], len(part) * len(self.ids)
            n = self.n[block]
            at = np.repeat(self.starts[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[low : low + len(part)] = np.bincount(np.repeat(self.who[own] - low, n) * len(self.ids) + self.places[at], np.repeat(self.weight[own], n), cells).reshape(len(part), len(self.ids))
        return out

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """The scores for these queries (flags); -inf of documents without a shared term and for other queries."""
        pairs = queries[self.who]
        self.read += int(pairs.sum())
        s = self.sums(pairs)
        return np.where(s > 0, np.round(s * self.w.share(self.n_terms), DIGITS), -np.inf)

    def reaching(self, queries: np.ndarray, top: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The same for documents that can reach the queries' thresholds."""
        order = np.lexsort((self.block, self.gain, self.who))
        who, below = self.who[order], np.cumsum(self.gain[order])
        first = np.searchsorted(who, np.arange(self.queries))
        before = np.concatenate([[0.0], below])[first]
        optional = np.zeros(len(who), bool)
        optional[order] = (below - before[who]) * top[who] + SLACK < least[who]
        pairs = queries[self.who]
        needed = pairs & ~optional
        s, spare = self.sums(needed), np.bincount(self.who[pairs & optional], self.gain[pairs & optional], self.queries)
        may = (s > 0) & ((s + spare[:, None]) * self.w.share(self.n_terms) + SLACK >= least[:, None])
        more = may.any(axis=1) & (np.bincount(self.who[pairs & optional], minlength=self.queries) > 0)
        self.read += int(needed.sum()) + int((pairs & optional & more[self.who]).sum())
        if more.any():
            s = np.where(more[:, None], self.sums(pairs & more[self.who]), s)  # all terms in one order, so equal documents round alike
        return np.where(may, np.round(s * self.w.share(self.n_terms), DIGITS), -np.inf)


def search(index: Index, queries: DataFrame, top_k: int, k1: float = K1, b: float = B, floor: float | None = IDF_FLOOR) -> Search:
    """queries (a stated set): query_id, text."""
    spark = queries.sparkSession
    stats = index.stats.first()  # one row
    n, avg_len = stats["n"], stats["avg_len"]
    asked = stored(queries.select("query_id", F.explode_outer(text.terms(F.col("text"))).alias("token")))
    if asked.count() > MAX_ASKED:
        raise ValueError(f"queries have over {MAX_ASKED} terms; give them in blocks")
    rows = asked.collect()  # a stated set
    tokens = asked.select("token").distinct().unionByName(spark.range(1).select(F.lit(None).cast("string").alias("token"))).distinct()
    own = index.blocks.join(F.broadcast(tokens.withColumnRenamed("token", "known")), F.col("token").eqNullSafe(F.col("known")), "left_semi")  # the stated queries' terms
    dealt = stored(own.repartition("range").sortWithinPartitions("range", F.asc_nulls_first("token")))
    value = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    df = dealt.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("df"))
    idf = {r.token: r.idf for r in df.select("token", (F.greatest(value, F.lit(floor)) if floor is not None else value).alias("idf")).collect()}
    names = list(dict.fromkeys(r.query_id for r in rows))
    w = Weighing(streamed.asked(names, sorted({(r.query_id, r.token, idf[r.token]) for r in rows if r.token in idf}, key=lambda p: p[1])), avg_len, k1, b)
    shared, number = spark.sparkContext.broadcast(w), {q: i for i, q in enumerate(names)}

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Range]]:
        tokens = pa.array(shared.value.asked.tokens, pa.string())
        for at, rows in by_range(batches):
            yield at, Range(rows, tokens, shared.value)

    def bounded(batches: Iterator[pa.RecordBatch]) -> streamed.Slices:
        for at, r in ranges(batches):
            yield r.bounds()[1][:, None], np.array([at]), np.array([at])

    def mapped(source: DataFrame, score: Callable, doc_id: StructField, k: int) -> DataFrame:
        schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), doc_id, StructField("doc_pos", LongType()), StructField("score", DoubleType())])
        return source.mapInArrow(streamed.run(score, streamed.best_of(names, k), to_arrow_schema(schema)), schema)

    def best(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_pos"))).filter(F.col("rank") <= k)

    first: dict[int, list[int]] = {}  # FIRST ranges a query
    for r in best(mapped(dealt, bounded, StructField("doc_id", LongType()), FIRST), FIRST).collect():
        first.setdefault(r.doc_id, []).append(number[r.query_id])
    early_of = spark.sparkContext.broadcast(first)

    def flags(at: int) -> np.ndarray:
        out = np.zeros(len(shared.value.asked.names), bool)
        out[early_of.value.get(at, [])] = True
        return out

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, np.ndarray]]:
        for at, r in ranges(batches):
            if at in early_of.value:
                yield r, r.scores(flags(at))

    doc = StructField("doc_id", index.docs.schema["doc_id"].dataType)
    scored = lambda of: lambda batches: ((s, r.ids, r.pos) for r, s in of(batches))
    early = stored(best(mapped(dealt, scored(opening), doc, top_k), top_k))
    reached = np.full(len(names), -1.0)  # without a k-th score any may come in
    for r in early.filter(F.col("rank") == top_k).collect():  # one a query
        reached[number[r.query_id]] = r.score
    least = spark.sparkContext.broadcast(reached)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, np.ndarray]]:
        for at, r in ranges(batches):
            top, bound = r.bounds()
            may = (bound > -np.inf) & (bound + SLACK >= least.value) & ~flags(at)
            if may.any():
                yield r, r.reaching(may, top, least.value)

    late = mapped(dealt, scored(rest), doc, top_k)
    nothing = index.docs.orderBy("doc_pos").limit(top_k).select("doc_id", F.col("doc_pos").cast("long").alias("doc_pos"), F.lit(0.0).alias("score"))
    fill = queries.select("query_id").distinct().join(F.broadcast(nothing))  # top_k rows a query
    lists = early.drop("rank").unionByName(late).unionByName(fill.select("query_id", "doc_id", "doc_pos", "score"))
    found = best(lists.groupBy("query_id", "doc_id", "doc_pos").agg(F.max("score").alias("score")), top_k)

    def count(of: Callable[[Iterator[pa.RecordBatch]], Iterator[int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([sum(of(batches))], pa.int64())], ["blocks"])

        return dealt.mapInArrow(run, "blocks long").agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"))

    every = count(lambda batches: (len(r.who) for _, r in ranges(batches)))
    return Search(found, every, count(lambda b: (r.read for r, _ in opening(b))).unionByName(count(lambda b: (r.read for r, _ in rest(b)))).agg(F.sum("blocks").alias("blocks")))
