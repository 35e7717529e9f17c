"""The corpus pipeline: documents to pieces, in five stages.

Each stage takes what its predecessor kept and writes its result, which the next one reads again.
The first four return rows of ``documents`` with all their columns; the last one returns a row of
figures for each document left.

- language: documents without a letter, or with less than half their letters in one language, go.
- quality: documents that the quality model rejects go.
- near_dedup: of each group of near duplicates (five words, similarity 0.8) the smallest id stays.
  Rows that share an id are one document, of which one row stays; rows without an id all stay.
- decontamination: documents that contain a benchmark item go.
- pieces: encoding into pieces and back.

Row-wise stages carry whole rows through their operator; nothing is joined by id there.

Texts that are null or have no letter go in the first stage. Very long texts pass whole. Columns may
have any names beside doc_id and text, since whole rows are carried. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrail.llm import langid, quality_gam
from cohortrail.llm.decontaminate import drop_contaminated
from cohortrail.llm.neardup import NearDupParams, placed_duplicates
from cohortrail.llm.pieces import round_trips
from cohortrail.llm.places import choose, in_files, place
from cohortrail.llm.shared import Store

#: Where the vocabulary files of public tokenizers are.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Least share of a document's letters in its language.
LEAST_SHARE = 0.5


def _whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row under a name that no column has."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = langid.label_languages(
        _whole_rows(docs), docs.where(~langid.held_out()), key="row"
    )
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return labelled.where(kept).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_gam.held_out())
    scored = quality_gam.quality_scores(_whole_rows(docs), labels, key="row")
    return scored.where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that go are named by file and position; only these names and ids are shuffled."""
    store = Store(spark, "verdicts")
    docs = in_files(docs, store)
    found = placed_duplicates(docs, NearDupParams(width=5), store).where("doc_id is not null")
    found = store.keep(found.select("doc_id", "kept", "file", "position"))
    verdicts = found.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    special = store.keep(verdicts.where("not stays or rows > 1"))
    gone = found.join(special.where("not stays"), "doc_id", "left_semi").select("file", "position")
    repeated = special.where("stays and rows > 1")
    if not repeated.isEmpty():
        gone = gone.unionByName(_further_rows(docs, repeated, store))
    rows = _whole_rows(docs).select("row", *place(docs))
    return choose(rows, gone, store, inside=False).select("row.*")


def _further_rows(docs: DataFrame, repeated: DataFrame, store: Store) -> DataFrame:
    """Places of all rows of each id but one, the first by the hashes of text and row."""
    hashed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.struct(
            F.xxhash64("text").alias("text"),
            F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            *place(docs),
        ).alias("at"),
    )
    rows = store.keep(hashed.join(repeated, "doc_id", "left_semi"))
    first = rows.groupBy("doc_id").agg(F.min("at").alias("first"))
    return rows.join(first, "doc_id").where("at > first").select("at.file", "at.position")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trips(docs, PIECE_MODEL)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encoding),
]

#: SQL can express neither the classifiers nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir))
    return docs
