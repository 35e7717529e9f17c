"""Table and join audits. Keys are counted before they are joined, so no key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, ordered by name."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("tbl")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Number of key values, NULL included, that occur more than once."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("n_dup"))


def match_audit(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Counts a left join from fact to dim would show, repeated dim keys fanning out.

    A fact key seen n times that meets m dim rows gives n * max(m, 1) joined rows. Both sides
    are reduced to (key, count) first: a NULL or hot key becomes a single row before the
    shuffle, and the join reuses the partitioning of the two aggregations.
    """
    left = fact.groupBy(F.col(fact_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    right = (
        dim.where(F.col(dim_key).isNotNull())
        .groupBy(F.col(dim_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    n, m, key = F.col("n"), F.col("m"), F.col("key")

    def total(column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0).cast("long"))

    return left.join(right, "key", "left").agg(
        total(n * F.coalesce(m, F.lit(1))).alias("n_rows"),
        total(F.when(key.isNull(), n)).alias("n_null_key"),
        total(F.when(key.isNotNull() & m.isNull(), n)).alias("n_unmatched_nonnull"),
        total(F.when(m.isNull(), n)).alias("n_unmatched"),
        total(n * m).alias("n_matched"),
    )


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side and on both; a NULL key counts on its side, never as shared.

    One tagged union and one aggregation replace two distincts, a join and a cross join.
    """
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    both = F.col(key).isNotNull() & (F.col("l") == 1) & (F.col("r") == 1)
    return sides.agg(
        F.count_if(F.col("l") == 1).alias("n_left"),
        F.count_if(F.col("r") == 1).alias("n_right"),
        F.count_if(both).alias("n_both"),
    )
