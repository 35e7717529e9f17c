"""Manifests against a tree built node by node, and awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from cohortrail.llm import merkle
from cohortrail.llm.merkle import ascii_lower, manifest
from pyspark.sql import functions as F


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h("".join(shown))


def climb(nodes):
    """The last node, and each node's siblings (left, right) level by level."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % 16
            sides[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 16])))
        at = [p // 16 for p in at]
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], sides


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_the_book(rows):
    """Rows (doc_id, source, lang, n_chars, text) to rows of the manifest."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots, sides = {}, {}
    for source in order:
        trees[source].sort(key=lambda x: x[:3])
        subroots[source], sides[source] = climb([x[2] for x in trees[source]])
    root, above = climb([subroots[s] for s in order])
    out = []
    for source, upper in zip(order, above, strict=True):
        for (_, _, leaf, row), lower in zip(trees[source], sides[source], strict=True):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of((*row[:4], lowered(row[4])))
            for left, right in (path := [*lower, *upper]):
                node = h(left + node + right)
            proof = h("".join(left + right for left, right in path))
            out.append((row[0], leaf, subroots[source], root, proof, node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(df):
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(df, ascii_lower(F.col("text")), chosen)


def same(spark, rows):
    got = run(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_the_book(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_one_source(spark, n):
    same(spark, [(i, "s", "en", i, f"Text {i}") for i in range(n)])


def test_sources_of_all_sizes(spark):
    rng = random.Random(5)
    sizes = {None: 3, "": 1, "b": 17, "Z": 300, "ä": 2, "a": 1, **{f"s{k}": 1 for k in range(40)}}
    rows = [
        (i * 7 - 50, source, rng.choice(["en", None, ""]), rng.choice([i, None]), rng.choice(["Aé", "b", "", None]))
        for i, (source, size) in enumerate((s, n) for s, n in sizes.items() for _ in range(n))
    ]
    rng.shuffle(rows)
    same(spark, rows)


def test_several_blocks_of_a_source(spark):
    rows = [(i, "hot", "en", i, f"T{i % 9}") for i in range(2 * merkle.BLOCK + 1)]
    rows += [(i, "exact", "en", i, "X") for i in range(merkle.BLOCK)]
    same(spark, rows)


def test_several_tiers(spark, monkeypatch):
    """With blocks of 16 nodes, a source and the list of sources take four tiers."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "hot", "en", i, f"T{i}") for i in range(4100)]
    rows += [(i, f"s{i:04d}", "en", i, "A") for i in range(300)]
    same(spark, rows)


def test_awkward_rows(spark):
    long = "Very long \n" * 100_000
    rows = [
        (1, "s", "en", 3, "A"), (1, "s", "en", 3, "A"), (1, "s", None, 3, "A"), (None, "s", "en", 1, "N"),
        (None, None, None, None, None), (None, None, None, None, None), (2, "s", "", 0, ""), (5, "", "en", 9, long),
        (-3, "s", "en", -1, "10:x"), (2**62, "t", "en", 2**62, "İ"),
        *[(77, "copies", "en", 1, "Same") for _ in range(40)],
    ]
    same(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", "'x' as tree", "1 as place", "2 as node", "'y' as sides", "3 as row", "4 as leaf")
    assert sorted(map(tuple, run(clash).collect()), key=repr) == by_the_book(rows)
    assert run(df.limit(0)).collect() == []


def test_hot_source_is_numbered_in_parts(spark):
    """No partition of the numbering holds more than its share of one source's rows."""
    from cohortrail.llm.shared import Store

    nodes = spark.range(20_000).selectExpr("'one' as tree", "id % 3 as doc_id", "'same' as node")
    out = merkle.numbered(nodes, "tree", ["doc_id", "node"], Store(spark, "test"))
    rows = out.collect()
    assert sorted(r.place for r in rows) == list(range(20_000))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.place)] == sorted(r.doc_id for r in rows)
    assert {r.total for r in rows} == {20_000}
