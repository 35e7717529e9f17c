from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from cohortrail.llm.langid import UNKNOWN, LangIdParams, Words, held_out, label_languages, viterbi
from cohortrail.llm.queries import op2_language_id
from conftest import SF_DIR

VOWELS = {"aa": "a", "oo": "o", "яя": "я"}


def text(rng, lang, words):
    last = VOWELS[lang]
    letters = "бвгд" if lang == "яя" else "bcdf"
    return " ".join(
        "".join(rng.choice(letters) + last for _ in range(rng.randint(2, 4))) for _ in range(words)
    )


def training(spark):
    rng = random.Random(1)
    rows = [(text(rng, lang, 40), lang) for lang in VOWELS for _ in range(30)]
    return spark.createDataFrame([*rows, (None, "aa"), ("zz", None)], "text string, lang string")


def test_spans_of_mixed_text(spark):
    rng = random.Random(2)
    parts = [text(rng, lang, n) for lang, n in (("aa", 12), ("oo", 30), ("яя", 6))]
    mixed = " ".join(parts)
    df = spark.createDataFrame([(1, mixed)], "doc_id bigint, text string")
    [row] = label_languages(df, training(spark)).collect()
    assert [s.lang for s in row.spans] == ["aa", "oo", "яя"]
    assert [mixed[s.start : s.stop] for s in row.spans] == parts
    assert row.lang_pred == "oo"
    letters = [sum(c.isalpha() for c in p) for p in parts]
    assert abs(row.score - letters[1] / sum(letters)) < 1e-12


def test_awkward_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "123 !? \n"), (4, "ბგდ"), (5, "bababa"), (5, "bababa"),
        (None, "boboco"), (6, "ba" * 200_000), (7, "BABA CACA, DADA"), (8, "́"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, spans string")
    got = label_languages(df, training(spark)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k in (1, 2, 3, 8):
        assert (by_id[k].lang_pred, by_id[k].score) == (UNKNOWN, 0.0)
    assert by_id[4].lang_pred in VOWELS and by_id[4].score == 0.0
    assert [by_id[k].lang_pred for k in (5, None, 6, 7)] == ["aa", "oo", "aa", "aa"]
    assert label_languages(df.limit(0), training(spark)).collect() == []
    untrained = label_languages(df, training(spark).limit(0)).collect()
    assert {r.lang_pred for r in untrained} == {UNKNOWN} and len(untrained) == len(rows)


def test_viterbi_equals_search_over_all_paths():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 6, 1, 6])
    scores = rng.normal(size=(counts.sum(), 3)) * 2
    labels = viterbi(scores.astype(np.float32), counts, 1.5)
    from itertools import product

    at = 0
    for n in counts.tolist():
        own = scores[at : at + n].astype(np.float32).astype(float)
        value = lambda p, own=own: sum(own[i, x] for i, x in enumerate(p)) - 1.5 * sum(
            a != b for a, b in zip(p, p[1:], strict=False)
        )
        best = max(map(value, product(range(3), repeat=n)))
        assert abs(value(labels[at : at + n].tolist()) - best) < 1e-6
        at += n


def test_labels_beyond_a_byte():
    """With 300 languages the last label comes back as itself, also after a switch."""
    scores = np.zeros((6, 300), dtype=np.float32)
    scores[:3, 299] = scores[3:, 43] = 9
    assert viterbi(scores, np.array([6]), 1.5).tolist() == [299, 299, 299, 43, 43, 43]


def test_words_break_at_scripts_and_rows():
    words = Words(pa.array(["ab1cd", "", "efЖж", None, "gh"]), LangIdParams().buckets)
    assert words.counts.tolist() == [2, 0, 2, 0, 1]
    assert (words.starts - words.row_starts[words.row]).tolist() == [0, 3, 0, 2, 0]
    assert words.lengths.tolist() == [2, 2, 2, 2, 2]
    assert words.has_letter.tolist() == [True, False, True, False, True]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = op2_language_id(spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    unseen = [r for r in got if r.held_out]
    assert 150 < len(unseen) < 350
    assert sum(r.lang_pred == r.lang for r in unseen) / len(unseen) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_do_not_teach(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = docs.where(~held_out())
    assert Counter(r[0] for r in docs.select(held_out()).collect())[False] == seen.count()
