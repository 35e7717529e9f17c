from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from cohortrail.llm.components import connected_components
from cohortrail.llm.neardup import (
    NearDupParams,
    _size_blocks,
    near_duplicates,
    similarity_sketch,
)
from cohortrail.llm.shared import Store
from cohortrail.llm.textscan import shingle_hashes, slices, word_hashes


def shingles(text: str | None, width: int) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_force(rows: list[tuple], width: int, percent: int = 80) -> dict:
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), i == root(i)) for i in ids}


def rows_of(seed: int, groups: int, copies: int, words: int) -> list[tuple]:
    """Groups of copies with up to a third of their words changed, so similarities straddle 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    rows, doc_id = [], 0
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, words // 9)):
                text[rng.randrange(words)] = word()
            rows.append((doc_id, rng.choice([" ", "\n", " \t"]).join(text)))
            doc_id += 1
    return rows


def result(df) -> dict:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    rows = rows_of(width, groups=40, copies=12, words=60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_duplicates(df, NearDupParams(width=width))) == brute_force(rows, width)


def test_large_buckets_lose_no_link(spark):
    rows = rows_of(5, groups=3, copies=150, words=50)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    params = replace(NearDupParams(width=2), small_bucket=4, block_shingles=800, heads=1)
    assert result(near_duplicates(df, params)) == brute_force(rows, 2)


def test_clusters_of_many_sizes_lose_no_link(spark):
    """Texts of one boilerplate, cut at many lengths and with own words among it."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for doc_id in range(260):
        words = base[: rng.randint(20, 120)]
        for _ in range(rng.choice([0, 1, 3, 9, 30])):
            words.insert(rng.randrange(len(words)), f"own{rng.randrange(400)}")
        rows.append((doc_id, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block_shingles in (300, 1 << 19):
        params = replace(
            NearDupParams(width=2), small_bucket=4, block_shingles=block_shingles, heads=1
        )
        assert result(near_duplicates(df, params)) == brute_force(rows, 2)


def test_blocks_are_compared_only_if_their_sizes_are_near(spark):
    sizes = [10] * 40 + [11, 12, 40, 45, 100, 130] + [1000] * 3
    members = [(7, n, k % 5 == 0 or n == 40) for k, n in enumerate(sizes)]
    members += [(8, 10, True), (8, 12, False)]
    inside = spark.createDataFrame(members, "cluster bigint, n bigint, asks boolean")
    params = replace(NearDupParams(), block_shingles=100)
    of_size, pairs = _size_blocks(inside, params, Store(spark, "blocks"))
    block = {(r.cluster, r.n): r.block for r in of_size.collect()}
    assert len(block) == len({(c, n) for c, n, _ in members})
    got = {(r.cluster, r.block, r.query_block): (r.parts, r.asking) for r in pairs.collect()}
    for c, n, _ in members:
        for d, m, asks in members:
            if c == d and asks and 100 * min(n, m) >= 80 * max(n, m):
                assert (c, block[c, n], block[d, m]) in got
    assert (7, block[7, 10], block[7, 1000]) not in got
    assert (7, block[7, 1000], block[7, 10]) not in got
    # 40 sets of 10 are in four parts, eight of them ask.
    assert got[7, block[7, 10], block[7, 10]] == (4, 1)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (9, None), (8, ""), (7, " \n\t"), (6, "One"), (5, "one"), (4, "one two"),
        (3, long), (2, long + " tail"), (1, "é É"), (11, "É É"), (6, "One"), (None, "one"),
    ]
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "doc_id bigint, text string, node string, key int"
    )
    got = sorted(near_duplicates(df, NearDupParams(width=2)).collect(), key=str)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i].component_id for i in (9, 8, 7)] == [9, 8, 7]
    assert [by_id[i].n_shingles for i in (9, 8, 7, 6, 4)] == [0, 0, 0, 1, 1]
    assert by_id[6].component_id == 5 and not by_id[6].kept
    assert by_id[3].component_id == 2 and by_id[2].kept
    assert by_id[1].component_id == 1 and by_id[11].component_id == 11
    assert by_id[None].component_id is None and by_id[None].kept


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(df).collect() == []


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    sets = [pool[:1], pool[:900], pool[100:1000]]
    sketch = similarity_sketch(np.concatenate(sets), np.array([len(s) for s in sets]), 180)
    assert (sketch != np.uint64((1 << 64) - 1)).all()
    assert abs((sketch[1] == sketch[2]).mean() - 0.8) < 0.12


def test_word_hashes_match_words_across_blocks():
    texts = ["a" * 3_000_000 + " b", None, "b  C\tc", "", "x " * 700_000 + "y"]
    hashes, counts, begins = word_hashes(pa.array(texts))
    words = [w for t in texts for w in (t or "").lower().split()]
    assert counts.tolist() == [len((t or "").split()) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words))
    assert dict(zip(words, hashes.tolist(), strict=True))["b"] == hashes[1]
    _, n = shingle_hashes(hashes, counts, 2)
    assert n.tolist() == [1, 0, 2, 0, 700_000]


def test_slices_keep_every_row():
    batch = pa.record_batch({"text": ["abc", None, "d" * 50, "", "e"]})
    parts = list(slices(batch, "text", most_bytes=4))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch["text"].to_pylist()


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(path, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df, Store(spark, "cc")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
