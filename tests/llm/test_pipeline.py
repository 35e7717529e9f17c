from __future__ import annotations

import corpus_pipeline
import pytest
from conftest import SF_DIR
from cohortrail.llm import langid, quality_gam
from test_decontaminate import brute_force as contained
from test_neardup import brute_force as components


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(300)


@pytest.fixture(scope="module")
def awkward(spark, docs):
    rows = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "123", "en", "s", 3)]
    rows += [tuple(docs.first())] * 2 + [(None, docs.first().text, "en", "s", 1)]
    rows += [(5003, docs.first().text + " tail", "en", "s", 1), (5004, "the and of " * 60_000, "en", "s", 1)]
    extra = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(extra).selectExpr("*", "'x' as score", "1 as row", "2 as key", "3 as id")


def test_stages_keep_the_columns_of_documents(spark, awkward):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF_DIR)
        assert out.schema.simpleString() == awkward.schema.simpleString(), name
        assert stage(spark, awkward.limit(0), SF_DIR).collect() == [], name


def test_language_and_quality_decide_as_their_operators(spark, awkward):
    got = corpus_pipeline.language(spark, awkward, SF_DIR)
    labels = langid.label_languages(awkward, awkward.where(~langid.held_out()))
    assert ids(got.where("doc_id is not null")) == ids(
        labels.where("doc_id is not null and lang_pred <> 'und' and score >= 0.5")
    )
    assert {5000, 5001, 5002}.isdisjoint(ids(got.where("doc_id is not null")))
    assert got.count() > 290
    got = corpus_pipeline.quality(spark, awkward, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~quality_gam.held_out())
    scored = quality_gam.quality_scores(awkward, labels).where("predicted = 1")
    assert got.count() == scored.count() > 200


def test_one_document_of_each_group_stays(spark, awkward):
    got = corpus_pipeline.near_dedup(spark, awkward, SF_DIR)
    rows = {r.doc_id: r.text for r in awkward.where("doc_id is not null").collect()}
    want = [k for k, (_, _, kept) in components(list(rows.items()), 5).items() if kept]
    assert ids(got.where("doc_id is not null")) == sorted(want)
    assert got.where("doc_id is null").count() == 1 and 5003 not in want


def test_contaminated_documents_go(spark, awkward):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    rows = [(r.doc_id, r.text) for r in awkward.where("doc_id is not null").collect()]
    dirty = {d for d, *_ in contained(rows, [(r.item_id, r.text) for r in items])}
    got = corpus_pipeline.decontamination(spark, awkward.where("doc_id is not null"), SF_DIR)
    assert dirty and ids(got) == sorted(k for k, _ in rows if k not in dirty)


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert sorted(out.collect()) == sorted(docs.collect())
    assert 0 < out.count() < 1000 and out.where("not round_trip").count() == 0
