"""Event rates per person-year over calendar periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.functions.columns import DAYS_PER_YEAR, days_between, ratio


@dataclass(frozen=True)
class Calendar:
    """Whole periods of ``months`` months from January of first_year to the end of last_year."""

    first_year: int
    last_year: int
    months: int

    @property
    def size(self) -> int:
        return (self.last_year - self.first_year + 1) * 12 // self.months

    @property
    def start(self) -> date:
        return date(self.first_year, 1, 1)

    @property
    def stop(self) -> date:
        """First day after the last period."""
        return date(self.last_year + 1, 1, 1)

    def starts(self) -> Column:
        """The first day of every period, in order, as an array."""
        first = F.make_date(F.lit(self.first_year), F.lit(1), F.lit(1))
        last = F.make_date(F.lit(self.last_year), F.lit(13 - self.months), F.lit(1))
        return F.sequence(first, last, F.expr(f"interval {self.months} months"))

    def last_day(self, start: Column) -> Column:
        return F.date_sub(F.add_months(start, self.months), 1)

    def position(self, ts: Column) -> Column:
        """Zero-based number of the period a timestamp falls in."""
        months = (F.year(ts) - self.first_year) * 12 + F.month(ts) - 1
        return F.floor(months / self.months)

    def covers(self, ts: Column) -> Column:
        """Half-open range on the raw timestamp, so that it reaches the scan."""
        return (ts >= F.lit(self.start).cast("timestamp_ntz")) & (
            ts < F.lit(self.stop).cast("timestamp_ntz")
        )


def _is_flagged(flag: str, summed: bool) -> Column:
    return F.col(flag) > 0 if summed else F.col(flag) == 1


def observed_entities(
    events: DataFrame, calendar: Calendar, *, entity: str, ts: str, flag: str, summed: bool = False
) -> DataFrame:
    """first_ts, last_ts and the flagged events of each period (``counts``, an array) per entity.

    One scan and one exchange of partial sums, a row per entity and task: a column for each period
    of the calendar stands in for a map gathered per entity. ``summed`` says that rows are days and
    ``flag`` the number of a day's flagged events.
    """
    at, number = calendar.position(F.col(ts)), F.col(flag).cast("long") if summed else F.lit(1)
    flagged = _is_flagged(flag, summed)
    counts = [
        F.sum(F.when(flagged & (at == k), number.cast("long")).otherwise(0))
        for k in range(calendar.size)
    ]
    return events.groupBy(entity).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array(*counts).alias("counts")
    )


def rates_of_members(members: DataFrame, calendar: Calendar, *, label: str) -> DataFrame:
    """Flagged events, person-years and members with any flagged event, per period and label.

    ``members`` holds a label, first_ts, last_ts, ``times`` (how often it counts) and ``counts`` per
    period (NULL: none); both end days count as observed, and a member without dates counts for
    every whole period. Each emits one row per period, observed or not: every label shows all
    periods without a cross join, and the rows meet a partial aggregation in the same stage.
    """
    periods = members.select(
        label,
        "times",
        F.to_date("first_ts").alias("first_day"),
        F.to_date("last_ts").alias("last_day"),
        "counts",
        F.posexplode(calendar.starts()).alias("position", "period_start"),
    )
    start, end = F.col("period_start"), calendar.last_day(F.col("period_start"))
    observed = days_between(F.greatest("first_day", start), F.least(F.col("last_day"), end)) + 1
    n_events = F.coalesce(F.get("counts", F.col("position")), F.lit(0).cast("long"))
    totals = periods.select(
        label,
        "period_start",
        "times",
        F.greatest(observed, F.lit(0).cast("long")).alias("days"),
        n_events.alias("n"),
    ).groupBy(label, "period_start").agg(
        F.sum(F.col("n") * F.col("times")).alias("n_events"),
        (F.sum(F.col("days") * F.col("times")) / F.lit(DAYS_PER_YEAR)).alias("person_years"),
        F.sum("times").alias("n_patients"),
        F.count_if(F.col("n") > 0).alias("n_any"),
    )
    return totals.select(
        label,
        "period_start",
        ratio(F.col("n_events"), F.col("person_years")).alias("value"),
        "n_events",
        "person_years",
        "n_patients",
        ratio(F.col("n_any"), F.col("n_patients")).alias("pct_any"),
    )


def person_time_rates(
    cohort: DataFrame,
    events: DataFrame,
    calendar: Calendar,
    *,
    entity: str,
    label: str,
    ts: str,
    flag: str,
    summed: bool = False,
) -> DataFrame:
    """Rates of a cohort with dates of its own: entity, a numeric label, first_ts and last_ts.

    A cohort may list an entity more than once; its time and events then count that often. Only
    flagged events within the calendar are read.
    """
    flagged = events.where(_is_flagged(flag, summed) & calendar.covers(F.col(ts)))
    found = observed_entities(flagged, calendar, entity=entity, ts=ts, flag=flag, summed=summed)
    members = cohort.groupBy(entity).agg(
        F.min(label).alias(label),
        F.count(F.lit(1)).alias("times"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    counted = members.join(found.select(entity, "counts"), entity, "left")
    return rates_of_members(counted, calendar, label=label)
