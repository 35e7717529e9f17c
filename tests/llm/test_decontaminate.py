from __future__ import annotations

import random
import re

import numpy as np
from cohortrail.llm.decontaminate import (
    ContainmentParams,
    ItemIndex,
    choose_bands,
    contained_items,
    drop_contaminated,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text: str | None) -> set:
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(docs, items) -> set:
    out, held = set(), {doc_id: shingles(doc) for doc_id, doc in docs}
    grams = {
        k: {d: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for d, w in words.items()}
        for words in [{d: words_of(doc) for d, doc in docs}]
        for k in range(1, 5)
    }
    for item_id, text in set(items):
        wanted = shingles(text)
        n = len(words_of(text))
        if 0 < n < 5:
            out |= {(d, item_id, 1, 1) for d, g in grams[n].items() if tuple(words_of(text)) in g}
            continue
        for doc_id in held:
            shared = len(wanted & held[doc_id])
            if wanted and 100 * shared >= 80 * len(wanted):
                out.add((doc_id, item_id, len(wanted), shared))
    return out


def test_equals_brute_force_over_sizes_and_places(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(1, 5)))
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 150)))) for k in range(80)]
    items += [(100, "x " * 40), (101, "x y " * 30)]
    docs = []
    for doc_id in range(120):
        words = [word() for _ in range(rng.choice([5, 80, 700, 6000]))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                item[rng.randrange(len(item))] = word()
            at = rng.randrange(len(words))
            words[at:at] = item
        text = "".join(w + rng.choice([" ", ", ", ".\n", " -- "]) for w in words)
        docs.append((doc_id, text.upper() if rng.random() < 0.2 else text))
    got = contained_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    expected = brute_force(docs, items)
    assert len(expected) > 40
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == expected
    assert len(got) == len(expected)


def test_item_blocks_give_the_same_rows(spark):
    items = [(k, f"alpha{k} beta gamma delta epsilon zeta eta theta") for k in range(20)]
    docs = [(k, "noise " * 50 + items[k][1] + " noise" * 50) for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    one = contained_items(d, i).collect()
    many = contained_items(d, i, ContainmentParams(block_bytes=200)).collect()
    assert sorted(one) == sorted(many) and len(one) == 20


def test_item_blocks_drop_the_same_rows(spark, tmp_path):
    items = [(k, f"alpha{k} beta gamma delta epsilon zeta eta theta") for k in range(20)]
    docs = [(k % 30, "noise " * 50 + (items[k % 40][1] if k % 40 < 20 else "end"), k) for k in range(80)]
    docs += [(None, None, -1), (None, "x " + items[3][1], -2), (5, "", -3)]
    i = spark.createDataFrame([*items, (None, None)], "item_id bigint, text string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, position int")
    kept = sorted(r.position for r in drop_contaminated(d, i).collect())
    assert kept == sorted([k for k in range(80) if k % 40 >= 20] + [-1, -3])
    many = ContainmentParams(block_bytes=200)
    d.repartition(3).write.parquet(f"{tmp_path}/docs")
    for table in (d, spark.read.parquet(f"{tmp_path}/docs")):
        got = drop_contaminated(table, i, many)
        assert got.columns == d.columns
        assert sorted(r.position for r in got.collect()) == kept
    assert drop_contaminated(d.limit(0), i, many).collect() == []


def test_items_shorter_than_a_shingle_are_found_inside(spark):
    docs = [(1, "zero one two three four five six seven eight"), (2, "One, two -- THREE four!"),
            (3, "one two three"), (4, "four three two one"), (5, "two"), (6, None)]
    items = [(1, "one two three four"), (2, "two three"), (3, "two"), (4, "..."), (5, "nine")]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    found = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got}
    assert found == brute_force(docs, items) and len(got) == len(found)
    assert {(1, 1, 1, 1), (2, 1, 1, 1), (3, 2, 1, 1), (4, 3, 1, 1)} <= found


def test_awkward_rows(spark):
    item = "one two three four five six seven"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "..."), (5, "solo"), (None, item)]
    docs = [(1, item), (1, item), (None, "x " + item), (2, None), (3, ""), (4, " \n"), (5, "SOLO!")]
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in contained_items(d, i).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1), (1, 1), (1, None), (1, None), (None, 1), (None, None), (5, 5)], key=str
    )
    assert contained_items(d.limit(0), i).collect() == []
    assert contained_items(d, i.limit(0)).collect() == []


def test_bands_follow_the_similarity():
    assert choose_bands(0.19, 64, 1e-5) == (64, 1)
    assert choose_bands(0.8, 64, 1e-5)[1] > 2
    assert choose_bands(0.01, 64, 1e-5) is None


def test_size_classes_cover_items():
    index = ItemIndex([1, 2], [" ".join(f"w{i}" for i in range(n)) for n in (20, 70)],
                      ContainmentParams())
    assert sorted(index.classes) == [16, 128]
    assert all(isinstance(s, np.ndarray) for s in index.sets)
