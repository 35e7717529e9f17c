from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from cohortrail.llm.ngram_lm import (
    DELETED,
    RETAINED,
    UNSEEN,
    LmParams,
    _answer,
    _bucket_spans,
    _packed,
    _packed_keys,
    _unpacked,
    interpolated_scores,
    learn_weights,
    part_of,
)
from cohortrail.llm.queries import op4_deleted_interpolation
from conftest import SF_DIR


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def by_the_book(rows, weights):
    """Scores from plain dictionaries of counts."""
    taught = [tokens(t) for _, t, part in rows if part != UNSEEN]
    one = Counter(w for t in taught for w in t)
    two = Counter(p for t in taught for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for doc_id, text, _ in rows:
        own = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        score, before = 0.0, "<s>"
        for w in own:
            seen = len(taught) if before == "<s>" else one[before]
            l0, l1, l2 = weights[1 + int(math.log2(seen)) if seen else 0]
            p = l0 / (v + 1) + l1 * one[w] / max(n, 1) + l2 * two[before, w] / max(seen, 1)
            score, before = score + math.log10(p), w
        out.append((doc_id, len(own), sum(one[w] > 0 for w in own), n, base, score))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(60)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(0, 80)))
        rows.append((k, text, rng.choice([RETAINED] * 5 + [DELETED, UNSEEN])))
    rows += [(n, None, RETAINED), (n + 1, "", UNSEEN), (n + 2, "new\twords\n here", UNSEEN)]
    return [*rows, (None, "w1 w2", RETAINED), (0, rows[0][1], rows[0][2])]


@pytest.mark.parametrize("chunk_bytes", [400, 8 << 20])
def test_scores_equal_plain_counts(spark, chunk_bytes):
    rows = corpus(chunk_bytes, 150)
    df = spark.createDataFrame([(*r, 9) for r in rows],
                               "doc_id bigint, text string, part int, score int")
    params = replace(LmParams(), chunk_bytes=chunk_bytes, bucket_bytes=max(chunk_bytes // 4, 50))
    scored, weights = interpolated_scores(df.repartition(3), params)
    got = sorted((tuple(r) for r in scored.collect()), key=str)
    want = by_the_book(rows, weights)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_weights_maximise_held_out_likelihood():
    cells = pd.DataFrame(
        {"bucket": 4, "bigram": [30, -32768, 10], "unigram": [10, 12, -32768], "n": [50, 30, 7]}
    )
    params = LmParams()
    w = learn_weights(cells, params)[4]

    def value(w):
        ratio = lambda x: 0.0 if x == -32768 else math.exp(x * params.grid)
        return sum(
            r.n * math.log(w[0] + w[1] * ratio(r.unigram) + w[2] * ratio(r.bigram))
            for r in cells.itertuples()
        )

    best = value(w)
    for delta in ([-1, 1, 0], [1, -1, 0], [0, 1, -1], [0, -1, 1], [1, 0, -1], [-1, 0, 1]):
        moved = w + 0.003 * np.array(delta)
        if (moved > 0).all():
            assert value(moved) <= best + 1e-6


def test_probabilities_sum_to_one(spark):
    """Over the known words and one unknown, after one context."""
    rows = [(k, t, p) for k, (t, p) in enumerate(
        [("a b", RETAINED), ("a c", RETAINED), ("b a b", DELETED), ("a b c", RETAINED)])]
    extra = [(100 + k, f"a {w}", UNSEEN) for k, w in enumerate(["a", "b", "c", "zzz"])]
    df = spark.createDataFrame([*rows, *extra, (200, "a", UNSEEN)],
                               "doc_id bigint, text string, part int")
    _, weights = interpolated_scores(df)
    two = Counter({"b": 3, "c": 1, None: 0, "a": 0})
    one = Counter({"a": 4, "b": 4, "c": 2, None: 4})
    l0, l1, l2 = weights[1 + int(math.log2(4))]
    p = lambda w: l0 / 5 + l1 * one[w] / 14 + l2 * two[w] / 4
    assert abs(sum(map(p, ["a", "b", "c", None, "zzz"])) - 1) < 1e-9


def test_no_training_texts_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", UNSEEN)], "doc_id bigint, text string, part int")
    [row] = interpolated_scores(df)[0].collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(0.0)
    assert interpolated_scores(df.limit(0))[0].collect() == []


def test_query_beats_unigrams_on_held_out_texts(spark):
    got = op4_deleted_interpolation(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert len(got) == docs.count()
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    parts = Counter(r[0] for r in docs.select(part_of()).collect())
    assert parts[UNSEEN] == len(unseen) and parts[DELETED] > 0


@pytest.mark.parametrize("buckets", [1, 8, 1000, (1 << 31) - 1])
def test_buckets_are_even_parts_of_the_hash_range(buckets):
    rng = np.random.default_rng(buckets)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False)
    keys = np.unique(np.append(keys, np.array([0, (1 << 64) - 1], dtype=np.uint64)))
    there, spans = _bucket_spans(keys, buckets)
    want = [int(k) * buckets >> 64 for k in keys]
    got = [b for b, (x, y) in zip(there.tolist(), spans, strict=True) for _ in range(x, y)]
    assert got == want and len(set(there.tolist())) == len(there)
    assert _bucket_spans(keys[:0], buckets)[1] == []


def test_counts_of_a_corpus_need_more_than_32_bits():
    keys = np.array([3, 8, 11], dtype=np.uint64)
    rows = [("a", RETAINED, [3_000_000_000, 1, 7]), ("b", RETAINED, [3_000_000_000, 2, 0]),
            ("c", DELETED, [5_000_000_000, 0, 1 << 32])]
    group = pd.DataFrame({
        "bucket": 0, "chunk": [r[0] for r in rows], "part": [r[1] for r in rows],
        "keys": [_packed_keys(keys)] * 3, "counts": [_packed(np.array(r[2])) for r in rows],
    })
    out = _answer(group)
    for kept, gone in zip(out["kept"], out["gone"], strict=True):
        assert _unpacked(kept).tolist() == [6_000_000_000, 3, 7]
        assert _unpacked(gone).tolist() == [5_000_000_000, 0, 1 << 32]
    assert out["types"].sum() == 2 and out["kept_types"].sum() == 2
