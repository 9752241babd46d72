"""From documents to token ids: toxicity, language, near duplicates, mixture, encoding.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs; all but the last return the columns of documents, whatever those are (columns
beyond doc_id, text, lang and source are carried along, also with names that an operator uses itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import language_id, mixing, near_dedup, sentencepiece_bpe, toxicity
from lumenfold.llm.common import kept_names, scratch, table
from lumenfold.llm.queries import tokenizer_path

ROW = "__document"


def _packed(docs: DataFrame) -> DataFrame:
    """Each document as one struct beside its text, so that no column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW), F.col("text").alias("__text"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(ROW)[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, taught by the labels, doesn't call toxic."""
    net = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    judged = toxicity.predict(_packed(docs), net, text="__text", keep=(ROW,))
    return _unpacked(judged.filter("predicted = 0"), docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language comes near; letterless ones and random characters go."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    judged = language_id.predict(_packed(docs), model, text="__text", keep=(ROW,))
    return _unpacked(judged.filter(F.col("lang_pred") != language_id.UNDETERMINED), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of texts whose five-word shingles are alike by 0.8 or more."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources more than once, up to one and a half times on average."""
    order = ("__at", "__block", "__place")  # the block permutations, which the written files are to hold
    mixed = mixing.mix(docs, limit=1.5).repartitionByRange(*order).sortWithinPartitions(*order)
    return mixed.select(*(F.col(f"`{n}`").alias(c) for c, n in zip(docs.columns, kept_names(docs.columns, mixing.MADE), strict=True)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed) and the decoded text's digest."""
    coded = sentencepiece_bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", sentencepiece_bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("encoding", encode),
]

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        at = scratch(spark, f"stage-{name}")
        out.write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
