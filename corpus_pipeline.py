"""A training-corpus pipeline in five stages, each written and read again between: see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontamination, language_id, sentencepiece_codec, simhash_dedup, suffix_dedup
from waymark.llm.common import in_fold, stored
from waymark.llm.queries import table, tokenizer_file
from waymark.session import attach

#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no text, no letter, or a score below LEAST_CERTAIN."""
    attach(spark)
    columns = docs.columns
    model = language_id.train(docs, F.col("doc_id").isNotNull() & ~in_fold("doc_id", 3, 1))
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(columns)))
    found = language_id.predict(renamed, model, carry=[f"_kept_{i}" for i in range(len(columns))])
    found = found.where((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= LEAST_CERTAIN))
    return found.select(*(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest id, a missing id counting as the largest.

    Of rows that share that id, the one whose text hashes lowest stays; of rows that share id and text, any one.
    """
    attach(spark)
    found = simhash_dedup.components_of(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), carry=["text_hash"])
    lead = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    one = lead.groupBy("component").agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("lead"))
    kept = stored(one.select(F.col("lead.doc_id").alias("_id"), F.col("lead.text_hash").alias("_hash"), F.col("lead.rows").alias("_rows")), "kept")
    mine = docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    single = docs.join(kept.where("_rows = 1"), mine, "left_semi")
    several = docs.join(kept.where("_rows > 1"), mine, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; documents of which nothing is left go, empty ones stay."""
    attach(spark)
    had = "had" + "_" * max(map(len, docs.columns))  # a name that no column has
    cut = suffix_dedup.without_repeats(docs.withColumn(had, F.coalesce(F.octet_length("text") > 0, F.lit(False))))
    cut = cut.where(~F.col(had) | (F.octet_length("text") > 0)).drop(had)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in cut.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; of rows that share an id, only those whose own text does. Items too short
    for edits (LeakParams.shortest) drop nothing, since a word or two is no leak; op2_short_items reports where they stand."""
    found = decontamination.leaks(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), table(spark, sf_dir, "benchmark"), carry=["text_hash"], short=False)
    bad = stored(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, with language and source."""
    attach(spark)
    return sentencepiece_codec.digests(docs, tokenizer_file("piece_bpe_32k.model"), carry=["lang", "source"])


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("decontamination", decontaminate), ("sentencepiece", tokenize)]

#: SQL cannot train the classifier or compute the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
