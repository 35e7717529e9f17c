from __future__ import annotations

from collections import Counter

import pytest
from cohortrail.llm.sharding import _hash, lookup_table, place


def by_the_book(shards, size):
    """Whole preference lists, walked from the front at every turn."""
    orders = [
        [(_hash(f"{s}/offset") + j * (_hash(f"{s}/skip") % (size - 1) + 1)) % size
         for j in range(size)]
        for s in shards
    ]
    table = [None] * size
    for turn in range(size):
        shard = turn % len(shards)
        table[next(p for p in orders[shard] if table[p] is None)] = shard
    return table


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (13, 211)])
def test_table_equals_the_definition(n, size):
    shards = [f"s{k}" for k in range(n)]
    table = lookup_table(shards, size).tolist()
    assert table == by_the_book(shards, size)
    held = Counter(table).values()
    assert max(held) - min(held) <= 1


def test_few_slots_move_when_a_shard_leaves():
    shards = [f"s{k}" for k in range(10)]
    before, after = lookup_table(shards, 4099), lookup_table(shards[:-1], 4099)
    stayed = before != 9
    assert (before[stayed] != after[stayed]).mean() < 0.1


def test_bad_tables_are_refused():
    for shards, size in ((["a"], 4), (["a", "b", "c"], 2), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            lookup_table(shards, size)


def test_awkward_rows(spark):
    rows = [("a", 1), ("a", 2), (None, 3), ("", 4), ("long" * 50_000, 5)]
    df = spark.createDataFrame(rows, "k string, slot int").withColumnRenamed("slot", "shard")
    df = df.selectExpr("k", "shard as n", "'x' as slot", "'y' as moved", "'z' as shard")
    got = {r.n: r for r in place(df, "k", ["a", "b"], 101, leaving=["b"]).collect()}
    assert len(got) == 5
    assert got[1].slot == got[2].slot and got[3].slot == got[4].slot
    assert all(r.shard_after == "a" and r.moved == (r.shard == "b") for r in got.values())
    assert place(df.limit(0), "k", ["a"], 7).collect() == []
