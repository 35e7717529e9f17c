"""Grouped counts, top-k and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.functions.columns import quantiles


def dedup_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key with some non-NULL value per column; the smallest, so reruns agree."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in rest])


def grouped_counts(df: DataFrame, by: list[Column], measures: list[Column], count: str) -> DataFrame:
    """Row count and further measures per group, largest group first, equal counts by group."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count), *measures)
    keys = [F.col(c).asc_nulls_last() for c in counted.columns[: len(by)]]
    return counted.orderBy(F.col(count).desc(), *keys)


def top_groups(df: DataFrame, by: list[str], count: str, k: int) -> DataFrame:
    """The k largest groups; equal counts are ordered by the group key."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))
    return counted.orderBy(F.col(count).desc(), *[F.col(c).asc_nulls_last() for c in by]).limit(k)


def distribution(df: DataFrame, measure: str, entity_count: str, approx: bool = False) -> DataFrame:
    """Size, range, quartiles, 95th percentile and mean of a per-entity count."""
    short = measure.removeprefix("n_")
    summary = df.agg(
        F.count(F.lit(1)).alias(entity_count),
        F.min(measure).alias(f"min_{short}"),
        quantiles(measure, [0.25, 0.5, 0.75, 0.95], approx).alias("q"),
        F.max(measure).alias(f"max_{short}"),
        F.avg(measure).alias(f"mean_{short}"),
    )
    names = ["q25", "median", "q75", "q95"]
    return summary.select(
        entity_count,
        f"min_{short}",
        *[F.col("q")[i].alias(name) for i, name in enumerate(names)],
        f"max_{short}",
        f"mean_{short}",
    )
