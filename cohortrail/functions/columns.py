"""Column helpers shared by the operators. All stay inside built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed from start to end, as a long."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("long")


def share(predicate: Column) -> Column:
    """Mean of a predicate; rows where it is NULL stay out of the denominator."""
    return F.avg(predicate.cast("int"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio, NULL where the denominator is zero."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def quantiles(column: str | Column, at: list[float], approx: bool = False) -> Column:
    """Interpolated quantiles as an array, all from one pass over the values.

    The exact form counts distinct values, so use it where those are few: visit counts, days.
    ``approx`` trades exactness for a sketch of fixed size.
    """
    points = F.array(*[F.lit(q) for q in at])
    if approx:
        return F.percentile_approx(column, points, 10000).cast("array<double>")
    return F.percentile(column, points)


def quantile(column: str | Column, q: float, approx: bool = False) -> Column:
    """One interpolated quantile."""
    return quantiles(column, [q], approx)[0]


def ranked(column: Column, values: Iterable[str]) -> Column:
    """Position of a value in a fixed display order, NULL if it is not listed."""
    rank = F.lit(None).cast("int")
    for position, value in reversed(list(enumerate(values, start=1))):
        rank = F.when(column == value, F.lit(position)).otherwise(rank)
    return rank


def lookup(column: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Label of a value from fixed (value, label) pairs, NULL if it is not listed."""
    label = F.lit(None).cast("string")
    for value, text in pairs:
        label = F.when(column == value, F.lit(text)).otherwise(label)
    return label


def fixed(column: Column, decimals: int) -> Column:
    """Fixed-decimal text with ties going to the even digit, NULL for NULL."""
    return F.when(
        column.isNotNull(), F.format_string(f"%.{decimals}f", F.bround(column, decimals))
    )


def percent(column: Column) -> Column:
    """A share as whole percent text, such as '43%'."""
    return F.concat(fixed(column * 100.0, 0), F.lit("%"))


def thousands(column: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(column, 0)
