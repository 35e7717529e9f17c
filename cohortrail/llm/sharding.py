"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, given by an offset
and a step from hashes of its name. Shards take turns, each claiming the first free slot of its
order, until the table is full: shards hold equally many slots but for one, and when a shard
leaves, few slots of the others change hands. A key's slot is its hash modulo the table size, so
placement is one lookup in a table whose size is a parameter and which is broadcast.

Awkward input: a null key is placed as the empty text. Repeated keys share a slot. An empty table
gives an empty result. Columns of the input stay; those added replace columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that make a hash: 60 bits.
_DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> np.ndarray:
    """The number of the shard that holds each slot; shards take turns in the order given."""
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    at = [_hash(f"{name}/offset") % size for name in shards]
    step = [_hash(f"{name}/skip") % (size - 1) + 1 for name in shards]
    table = np.full(size, -1, dtype=np.int32)
    for turn in range(size):
        shard = turn % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % size
        table[at[shard]] = shard
    return table


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(size)).cast("int")


def place(
    df: DataFrame, key: str, shards: list[str], size: int, leaving: list[str] | None = None
) -> DataFrame:
    """``df`` with slot and shard of each row's key and, for shards about to leave, the shard
    after that and whether the row moves."""
    table = lookup_table(shards, size)
    rows = {"slot": range(size), "shard": [shards[i] for i in table]}
    if leaving:
        rest = [s for s in shards if s not in leaving]
        rows["shard_after"] = [rest[i] for i in lookup_table(rest, size)]
    fields = ", ".join(f"{name} {'int' if name == 'slot' else 'string'}" for name in rows)
    slots = df.sparkSession.createDataFrame(list(zip(*rows.values(), strict=True)), fields)
    kept = df.drop(*rows, "moved").withColumn("slot", slot_of(F.col(key), size))
    placed = kept.join(F.broadcast(slots), "slot")
    if leaving:
        placed = placed.withColumn("moved", F.col("shard") != F.col("shard_after"))
        return placed.select(*kept.columns, "shard", "shard_after", "moved")
    return placed.select(*kept.columns, "shard")
