from __future__ import annotations

import re

import corpus_pipeline
import pytest
from conftest import SF_DIR
from cohortrail.llm.places import BITMAP_BYTES, choose, in_files, place
from cohortrail.llm.shared import Store
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def store(spark):
    return Store(spark, "places")


@pytest.fixture(scope="module")
def table(spark, store):
    """100,000 rows in four files, so that files have several bitmaps, with clashing names."""
    rows = spark.range(0, 100_000, 1, 4).selectExpr(
        "id", "id as file", "id as position", "'x' as in_bits", "id as _metadata"
    )
    return store.keep(rows.where("id < 60000 or id >= 75000").repartition(2, "id"))



RULES = ["id % 7 = 3", "true", "false", "id in (0, 99999)", "id < 50000", "id % 32768 = 32767"]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("limit", [32 << 20, 2 * BITMAP_BYTES])
def test_rows_inside_and_outside_a_set_of_places(store, table, rule, limit):
    rows = table.select("id", *place(table))
    named = table.where(rule).select(*place(table))
    all_ids = {r.id for r in table.select("id").collect()}
    want = {r.id for r in table.where(rule).select("id").collect()}
    for inside in (True, False):
        got = choose(rows, named, store, inside=inside, broadcast_bytes=limit)
        assert got.columns == ["id", "file", "position"]
        ids = [r.id for r in got.select("id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) == (want if inside else all_ids - want)


def test_places_named_twice_count_once(store, table):
    rows = table.select("id", *place(table))
    named = table.where("id % 5 = 0").select(*place(table))
    got = choose(rows, named.unionAll(named), store, inside=False)
    assert got.where("id % 5 = 0").count() == 0 and got.count() == table.where("id % 5 > 0").count()


def test_only_tables_without_files_are_written(spark, store, table):
    before = store.tables
    assert in_files(table, store) is table and store.tables == before
    made = in_files(spark.range(5).withColumn("file", F.lit("f")), store)
    assert store.tables == before + 1
    rows = made.select("id", *place(made)).collect()
    assert len({(r.file, r.position) for r in rows}) == 5
    empty = in_files(spark.range(0), store)
    assert choose(empty.select("id", *place(empty)), empty.select(*place(empty)), store, inside=False).count() == 0


def exchanged(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_texts_stay_in_place_when_most_documents_go(spark):
    """Ten rows of each text: nine in ten rows go, and no exchange stands above a scan of texts."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").limit(60)
    copies = docs.crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    many = copies.withColumn("doc_id", F.col("doc_id") * 100 + F.col("copy")).drop("copy")
    path = Store(spark, "many").keep(many)
    got = corpus_pipeline.near_dedup(spark, path, SF_DIR)
    assert exchanged(got) == []
    kept = [r.doc_id for r in got.select("doc_id").collect()]
    alone = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()]
    assert len(kept) < 65 and sorted(kept) == sorted(100 * i for i in alone)


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (2, None), (2, None), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [
        sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, d, SF_DIR).collect())
        for d in (docs, docs.repartition(5).orderBy("text"))
    ]
    assert out[0] == out[1] and [r[0] for r in out[0]] == [1, 2, 3]
