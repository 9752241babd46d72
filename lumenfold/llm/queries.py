"""The operators of this subpackage as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import ann, bloom_lm, compaction, language_id, manifest, merkle, mixing, passages, phrases, sentencepiece_bpe, simhash, toxicity, url_filter
from lumenfold.llm.common import fold, scratch, table, written
from lumenfold.session import spread


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = fold(F.col("doc_id"), 5) == 0
    net = toxicity.train(docs.filter(~held_out).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(spread(table(spark, sf_dir, "documents")))


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, each followed by a compaction; every document with the shard that holds it in the last version."""
    docs = table(spark, sf_dir, "documents")
    store = compaction.Store(spark, scratch(spark, "store"))
    late = fold(F.col("doc_id"), 4) == 0
    for arrival in (docs.filter(~late), docs.filter(late)):
        store.append(arrival)
        store.compact()
    return store.members("doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as the corpus has, near equal weights, no source more than four times."""
    docs = spread(table(spark, sf_dir, "documents"))
    tokens = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), limit=4.0, budget=float(tokens))
    return mixed.select("doc_id", "source", F.col("__epoch").alias("epoch"), F.col("__at").alias("at"), F.col("__block").alias("block"), F.col("__place").alias("place"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held_out = fold(F.col("doc_id"), 5) == 1
    words, model = bloom_lm.train_model(docs.filter(~held_out))
    scored = bloom_lm.score(docs, words, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(spread(table(spark, sf_dir, "documents"))), "fingerprints")
    return prints.join(simhash.near_components(prints), "fp").select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public vocabulary file is; LUMENFOLD_TOKENIZERS names another folder."""
    if at := os.environ.get("LUMENFOLD_TOKENIZERS"):
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_bpe.encode(spread(table(spark, sf_dir, "documents")), tokenizer_path())
    return coded.select("doc_id", sentencepiece_bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(docs.select("doc_id", "text"), model, reject=False)
    return judged.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest.verified(spread(table(spark, sf_dir, "documents")), tampered)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = passages.remove(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_merkle": op2_merkle,
    "op3_compaction": op3_compaction,
    "op4_bloom_lm": op4_bloom_lm,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_filter": op8_url_filter,
    "op9_ann": op9_ann,
    "op10_language_id": op10_language_id,
    "op11_phrases": op11_phrases,
    "op12_manifest": op12_manifest,
    "op13_passages": op13_passages,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op8_url_filter": url_filter.oracle,
    "op11_phrases": phrases.oracle,
    "op12_manifest": manifest.oracle,
}
