"""Wide to long and back, with a residual category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_residual(df: DataFrame, parts: list[str], residual: str) -> DataFrame:
    """One minus the parts. Parts may overlap, so the residual may be negative; it stays so."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in parts])
    return df.withColumn(residual, F.lit(1.0) - total)


def to_long(df: DataFrame, ids: list[str], parts: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, parts, name, value)


def to_wide(df: DataFrame, rows: list[str], columns: str, levels: list[str], value: str) -> DataFrame:
    """One column per listed level; naming the levels saves the pass that would look for them."""
    return df.groupBy(*rows).pivot(columns, levels).agg(F.first(value))
