"""Choosing rows of a stored table by their place, so that texts stay where they are.

A row's place is its file and its position in it, which Spark gives for every row of a Parquet table
it reads. A set of places becomes bitmaps of 32,768 positions each, one bit a row. A scan meets the
bitmaps of its own files, broadcast, and passes or drops its rows: no text is shuffled, at any size
of the set. More bitmaps than ``BROADCAST_BYTES`` hold are dealt out by file: each share of the files is
scanned with its own bitmaps, one share after the other, and a scan lists only files of its share.

A table that is not read from Parquet files is written first. Rows of a table must have places of
their own, so a join or an explosion of a table has to be written before it comes here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store

#: Bytes of bitmaps that one scan broadcasts, and of one bitmap.
BROADCAST_BYTES, BITMAP_BYTES = 32 << 20, 4096


def in_files(docs: DataFrame, store: Store) -> DataFrame:
    """``docs`` if its rows have places, else the same rows written and read again."""
    try:
        docs.select(*place(docs))
    except AnalysisException:
        return store.keep(docs)
    return docs


def place(docs: DataFrame) -> tuple[Column, Column]:
    """Columns ``file`` and ``position``, whatever other columns are called."""
    meta = docs.metadataColumn("_metadata")
    return meta["file_path"].alias("file"), meta["row_index"].alias("position")


def choose(
    rows: DataFrame,
    places: DataFrame,
    store: Store,
    *,
    inside: bool,
    then: Callable[[DataFrame], DataFrame] = lambda chosen: chosen,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``then`` of the rows (file, position and others) whose place is, or is not, among ``places``."""
    number = F.col("position") + 1
    bitmaps = store.keep(
        places.select(
            F.col("file").alias("in_file"),
            F.bitmap_bucket_number(number).alias("in_bucket"),
            F.bitmap_bit_position(number).alias("bit"),
        )
        .groupBy("in_file", "in_bucket")
        .agg(F.bitmap_construct_agg("bit").alias("in_bits"))
    )
    shares = max(1, -(-bitmaps.count() * BITMAP_BYTES // broadcast_bytes))
    if shares == 1:
        return then(_chosen(rows, bitmaps, inside))

    def share(file: str) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(shares))

    parts = [
        store.keep(
            then(_chosen(rows.where(share("file") == k), bitmaps.where(share("in_file") == k), inside))
        )
        for k in range(shares)
    ]
    return reduce(DataFrame.unionAll, parts)


def _chosen(rows: DataFrame, bitmaps: DataFrame, inside: bool) -> DataFrame:
    number = F.col("position") + 1
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("in_bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    meets = (F.col("file") == F.col("in_file")) & (F.bitmap_bucket_number(number) == F.col("in_bucket"))
    joined = rows.join(F.broadcast(bitmaps), meets, "inner" if inside else "left")
    return joined.where(found if inside else ~F.coalesce(found, F.lit(False))).select(*rows.columns)
