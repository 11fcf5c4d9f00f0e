"""The operators applied to whole tables with production parameters: ``QUERIES`` and, where SQL can say it, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontamination, embedding_dedup, language_id, license_scan, lm_scoring, merkle, packing, sentencepiece_codec, simhash_dedup, sql, suffix_dedup, toxicity, url_filter, whitening
from waymark.llm.common import in_fold
from waymark.session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """Bytes of a public vocabulary file, read on the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_short_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2_decontamination that is about items too short for edits."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 10, 0))
    return scored.withColumn("held_out", in_fold("doc_id", 10, 0)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 3, 1))
    found = language_id.predict(docs, model)
    return found.withColumn("held_out", in_fold("doc_id", 3, 1)).select("doc_id", "held_out", "lang_pred", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, spans = F.array_distinct("base.label"), F.array_distinct("spans.label")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, spans)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
        "spans",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judge = toxicity.learn(docs, labels, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2))
    found = toxicity.score(docs, judge)
    return found.withColumn("held_out", in_fold("doc_id", 4, 2)).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.linked(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_decontamination, op2_short_items, op3_lm_scoring, op4_sentencepiece, op5_language_id, op6_suffix_dedup, op7_license_scan, op8_toxicity, op9_embedding_dedup, op10_simhash_dedup, op11_packing, op12_merkle_manifest, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": sql.url_filter(), "op6_suffix_dedup": sql.suffix_dedup(), "op9_embedding_dedup": sql.embedding_dedup(), "op12_merkle_manifest": sql.merkle_manifest()}
