"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortrail.llm import (
    fim,
    langid,
    merkle,
    ngram_lm,
    pieces,
    quality_gam,
    simhash,
    token_rollup,
)
from cohortrail.llm.decontaminate import contained_items
from cohortrail.llm.neardup import NearDupParams, near_duplicates
from cohortrail.llm.outliers import reject_outliers
from cohortrail.llm.sharding import place
from cohortrail.llm.shared import Store
from cohortrail.llm.warc import WarcParams, archive_round_trip

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
SHARDS = [f"shard-{k:02d}" for k in range(32)]
#: A prime of over a hundred slots a shard.
SLOTS = 4099


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document holds 80 % of the 5-word shingles or more."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    labelled = langid.label_languages(docs, docs.where(~langid.held_out()))
    return labelled.select(
        "doc_id",
        langid.held_out().alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches and a repeated one.

    All documents are counted in; those in which a line stands twice are revised to their text
    without the repeated lines; those whose text an earlier document has are taken out; the
    revisions come a second time; and UTF-8 bytes are counted as a second version.
    """
    docs = _table(spark, sf_dir, "documents")
    store = Store(spark, "tokens")
    rollup = token_rollup.TokenRollup(spark, f"{store.folder}/rollup")
    name = "byte_bpe_50k"
    fields = ["doc_id", "source", "lang"]

    counted = token_rollup.count_tokens(docs.select(*fields, "text"), name, TOKENIZERS)
    rollup.commit("1-insert", counted.withColumn("change", F.lit("insert")))

    lines = F.split("text", "\n")
    once = docs.select(*fields, F.array_distinct(lines).alias("once"), F.size(lines).alias("n"))
    shorter = once.where(F.size("once") < F.col("n")).select(
        *fields, F.array_join("once", "\n").alias("text")
    )
    revised = token_rollup.count_tokens(shorter, name, TOKENIZERS)
    revised = revised.withColumn("change", F.lit("revise"))
    rollup.commit("2-revise", revised)

    prints = docs.select(*fields, F.md5("text").alias("print")).where("print is not null")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = prints.join(store.keep(firsts.where("n > 1")), "print").where("doc_id <> first")
    gone = copies.select(
        *fields, F.lit(name).alias("tokenizer"), F.lit(0).cast("bigint").alias("n_tokens"),
        F.lit("delete").alias("change"),
    )
    rollup.commit("3-delete", gone)
    rollup.commit("2-revise", revised)

    as_bytes = docs.select(
        *fields, F.lit("utf8_bytes").alias("tokenizer"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_tokens"),
        F.lit("insert").alias("change"),
    )
    rollup.commit("4-bytes", as_bytes)
    return rollup.totals()


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a bigram model of those not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("part", ngram_lm.part_of())
    scored, _ = ngram_lm.interpolated_scores(docs)
    return scored.withColumn("held_out", ngram_lm.held_out())


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC files in segments of 16 KB and read back."""
    return archive_round_trip(
        _table(spark, sf_dir, "pages"), WarcParams(segment_bytes=16 << 10)
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(~quality_gam.held_out())
    scored = quality_gam.quality_scores(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", quality_gam.held_out().alias("held_out"), "score", "predicted")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are similar by 0.8 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), NearDupParams(width=2))


def op10_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, now and after the last shard has left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", SHARDS, SLOTS, leaving=SHARDS[-1:])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces and back."""
    return pieces.round_trips(
        _table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model"
    )


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept and rejected by base rules and robust distance per language and source."""
    return reject_outliers(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document cut for filling in, and of the text rebuilt from that."""
    cut = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root; a fifth of the texts are checked in small letters."""
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, merkle.ascii_lower(F.col("text")), chosen)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_language_id,
        op3_token_rollup,
        op4_deleted_interpolation,
        op5_warc_segments,
        op6_quality_classifier,
        op7_minhash_near_dedup,
        op8_sentencepiece,
        op9_robust_outliers,
        op10_shard_placement,
        op11_fill_in_middle,
        op12_simhash_near_dedup,
        op13_merkle_manifest,
    )
} | {
    "pipeline": corpus_pipeline.run
}
