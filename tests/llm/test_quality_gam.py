from __future__ import annotations

import numpy as np
import pyarrow as pa
from cohortrail.llm.quality_gam import (
    FEATURES,
    GamParams,
    features,
    fit,
    four_quadrants,
    quality_scores,
    shallow_tree,
)
from cohortrail.llm.queries import op6_quality_classifier
from conftest import SF_DIR


def test_features_of_whole_texts():
    texts = ["The cat sat.\nThe cat sat.\nÉté 42!", None, "", "A#B $$"]
    x = dict(zip(FEATURES, features(pa.array(texts)).T, strict=True))
    assert np.allclose(x["log_words"], np.log1p([8, 0, 0, 2]))
    assert np.allclose(x["distinct_lines"], [2 / 3, 1, 1, 1])
    assert np.allclose(x["distinct_words"], [5 / 8, 1, 1, 1])
    assert np.allclose(x["symbols"], [0, 0, 0, 3 / 6])
    assert np.allclose(x["digits"], [2 / len(texts[0]), 0, 0, 0])
    assert np.allclose(x["capitals"], [2 / 19, 0, 0, 1])
    assert np.allclose(x["beyond_ascii"], [2 / len(texts[0]), 0, 0, 0])
    assert np.isfinite(np.array(list(x.values()))).all()


def test_a_text_has_the_same_features_in_any_batch():
    texts = ["one two\nthree", "x" * 2_000_000 + " y", "", "Four! #five"]
    together = features(pa.array(texts))
    alone = np.concatenate([features(pa.array([t])) for t in texts])
    assert np.array_equal(together, alone)


def test_trees_take_the_best_cut():
    g = np.array([3.0, 3.0, -5.0, -5.0])
    assert np.allclose(shallow_tree(g, np.ones(4), 2, 0.0), [-3, -3, 5, 5])
    assert np.allclose(shallow_tree(g, np.ones(4), 1, 0.0), [1, 1, 1, 1])
    grid = np.array([[1.0, -1.0], [-1.0, 1.0]])
    gain, values = four_quadrants(grid, np.ones((2, 2)), 0.0)
    assert gain > 3 and np.allclose(values, -grid)


def test_pairs_catch_what_features_alone_cannot():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 4))
    y = (x[:, 0] * x[:, 2] > 0).astype(float)
    accuracy = lambda **kw: ((fit(x, y, GamParams(**kw)).score(x) > 0.5) == y).mean()
    assert accuracy(pairs=0, rounds=20) < 0.7 < 0.9 < accuracy(pairs=1, rounds=20)


def test_one_label_or_none():
    x = np.zeros((5, len(FEATURES)))
    assert (fit(x[:0], np.zeros(0), GamParams()).score(x) == 0.5).all()
    assert (fit(x, np.ones(5), GamParams()).score(x) > 0.5).all()


def test_awkward_rows(spark):
    docs = [(k, "fine words here " * 9 if k % 2 else "### $$$ " * 20) for k in range(60)]
    docs += [(100, None), (101, ""), (None, "fine words"), (1, "fine words here " * 9)]
    docs += [(102, "long " * 300_000)]
    labels = [(k, k % 2) for k in range(60)] + [(3, None), (None, 1), (5, 1), (5000, 0)]
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, text string")
    params = GamParams(rounds=30)
    got = quality_scores(d, lab, params).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = {r.doc_id: r.predicted for r in got}
    assert all(known[k] == k % 2 for k in range(60))
    assert quality_scores(d.limit(0), lab, params).collect() == []
    assert {r.score for r in quality_scores(d, lab.limit(0), params).collect()} == {0.5}


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = op6_quality_classifier(spark, SF_DIR)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    unseen = got.join(labels, "doc_id").where("held_out").collect()
    assert len(unseen) > 40
    assert sum(r.predicted == r.quality for r in unseen) / len(unseen) > 0.93
