"""Per-entity summaries of an event table: totals, gaps, first events, follow-up."""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.functions.columns import days_between


def entity_totals(
    events: DataFrame, *, entity: str, ts: str, flags: dict[str, str]
) -> DataFrame:
    """Event count, observed span and flag totals; the NULL entity is a group of its own."""
    return events.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_encounters"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        days_between(F.min(ts), F.max(ts)).alias("days_observed"),
        *[F.sum(flag).alias(name) for name, flag in flags.items()],
    )


#: What a daily rollup holds besides entity, day and the flags' sums.
DAY_COLUMNS = ("n", "first_ts", "last_ts")


def daily_rollup(
    events: DataFrame, *, entity: str, ts: str, flags: dict[str, str]
) -> DataFrame:
    """One row per entity and day: events ``n``, first and last time, flag totals.

    Undated events form a row without a day, those of the NULL entity rows of their own. Events are
    exchanged once, as partial sums spread by entity and day; totals, gaps, later days and events
    per period all follow from these rows, of which an entity has at most one per calendar day.
    """
    return events.groupBy(entity, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.sum(flag).alias(name) for name, flag in flags.items()],
    )


def rollup_with_distinct(
    events: DataFrame,
    *,
    entity: str,
    ts: str,
    flags: dict[str, str],
    distinct: dict[str, str],
) -> DataFrame:
    """The daily rollup and, as further rows, each distinct value of an entity.

    Events are reduced to one row per entity, day and values first; grouping sets (entity, day) and
    (entity, value) for each counted column then expand those rows, not events, so an entity with
    a third of all events is spread over its days and values in both steps. A value's row has no day
    and a 1 in the column that ``distinct`` names, ready to be summed; days are counted in
    ``n_distinct_days``. Measures stay with the day rows.
    """
    columns = list(distinct.values())
    reduced = events.groupBy(entity, F.to_date(ts).alias("day"), *columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.sum(flag).alias(name) for name, flag in flags.items()],
    )
    sets = [[entity, "day"], *[[entity, c] for c in columns]]
    # A grouping id has a bit for each column left out of the set, the first column's the highest.
    every = (1 << (len(columns) + 1)) - 1
    ids = [every - (1 << (len(columns) - k)) for k in range(len(columns) + 1)]
    grouped = reduced.groupingSets(sets, entity, "day", *columns).agg(
        F.grouping_id().alias("set"),
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *[F.sum(name).alias(name) for name in flags],
    )
    is_day = F.col("set") == ids[0]

    def one(test: Column) -> Column:
        return F.when(test, F.lit(1).cast("long"))

    return grouped.select(
        entity,
        "day",
        *[F.when(is_day, F.col(c)).alias(c) for c in (*DAY_COLUMNS, *flags)],
        one(is_day & F.col("day").isNotNull()).alias("n_distinct_days"),
        *[
            one((F.col("set") == number) & F.col(c).isNotNull()).alias(name)
            for (name, c), number in zip(distinct.items(), ids[1:], strict=True)
        ],
    )


def _totals(sums: Iterable[str]) -> list[Column]:
    """Totals of rolled-up rows; a count without any row is zero, a flag's sum stays NULL."""
    first, last = F.min("first_ts"), F.max("last_ts")
    return [
        F.sum("n").alias("n_encounters"),
        first.alias("first_ts"),
        last.alias("last_ts"),
        days_between(first, last).alias("days_observed"),
        *[F.sum(name).alias(name) for name in sums],
    ]


def _counted(df: DataFrame, counts: Collection[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def entity_summary(
    rows: DataFrame, *, entity: str, sums: Iterable[str], counts: Collection[str] = ()
) -> DataFrame:
    """Totals of each entity from rows of a daily rollup, with distinct values if it has them."""
    return _counted(rows.groupBy(entity).agg(*_totals([*sums, *counts])), counts)


# Names and ranks of the quartiles of a gap profile.
GAP_QUARTILES = {"gap_q25": 0.25, "gap_median": 0.5, "gap_q75": 0.75}


def entity_profile(
    rows: DataFrame, *, entity: str, sums: Iterable[str] = (), counts: Collection[str] = ()
) -> DataFrame:
    """Totals and gaps of each entity from rows of a daily rollup, in one pass.

    A gap counts midnights: n events on a day are n - 1 gaps of zero and one gap to the entity's
    next day. The rows of an entity are exchanged once and sorted twice, by day and by gap, with no
    table of gaps by hash between, which had a task hold its rows twice more. A running number of
    the gaps brackets each quartile between two of them, so quartiles are exact and interpolated
    without gathering an entity's gaps in one value. Undated events and rows of distinct values open
    and close no gap. Entities without a gap have NULLs in its columns.
    """
    following = F.lead("day").over(Window.partitionBy(entity).orderBy("day"))
    dated = F.col("day").isNotNull()
    lengths = rows.select(
        entity,
        F.when(dated, days_between(F.col("day"), following)).alias("gap"),
        F.when(dated, F.col("n") - 1).otherwise(0).alias("zeros"),
        "n",
        "first_ts",
        "last_ts",
        *sums,
        *counts,
    )
    whole = Window.partitionBy(entity)
    rising = whole.orderBy("gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lengths.withColumns(
        {
            # All zero gaps come before the others, which are at least a day long.
            "all_zeros": F.sum("zeros").over(whole),
            "n_gaps": F.sum(F.col("zeros") + F.col("gap").isNotNull().cast("long")).over(whole),
            "up_to": F.sum("zeros").over(whole) + F.count("gap").over(rising),
        }
    )
    gap, zeros, n = F.col("gap"), F.col("all_zeros"), F.col("n_gaps")
    place = {name: (n - 1) * q for name, q in GAP_QUARTILES.items()}

    def at(rank: Column) -> Column:
        """The gap of a rank from 0: the first whose running number is beyond it."""
        return F.min(F.when(zeros > rank, 0).when(F.col("up_to") > rank, gap))

    def band(test: Column) -> Column:
        return F.count_if(test)

    profile = placed.groupBy(entity).agg(
        *_totals([*sums, *counts]),
        F.max(n).alias("n_gaps"),
        F.max(zeros).alias("all_zeros"),
        *[at(F.floor(h)).cast("double").alias(f"{name}_lo") for name, h in place.items()],
        *[at(F.ceil(h)).cast("double").alias(f"{name}_hi") for name, h in place.items()],
        F.sum(gap).alias("gap_days"),
        band(gap <= 30).alias("le30"),
        band(gap <= 90).alias("le90"),
        band(gap > 180).alias("gt180"),
    )
    some = n > 0

    def between(name: str) -> Column:
        share = place[name] - F.floor(place[name])
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(some, low + share * (high - low)).alias(name)

    days = F.coalesce("gap_days", F.lit(0).cast("long")).cast("double")
    return _counted(profile, counts).select(
        entity,
        *["n_encounters", "first_ts", "last_ts", "days_observed", *sums, *counts],
        F.when(some, n).alias("n_gaps"),
        *[between(name) for name in GAP_QUARTILES],
        (days / F.nullif(n, F.lit(0))).alias("gap_mean"),
        F.when(some, zeros + F.col("le30")).alias("n_gap_le30"),
        F.when(some, zeros + F.col("le90")).alias("n_gap_le90"),
        F.when(some, F.col("gt180")).alias("n_gap_gt180"),
    )


def gap_profile(events: DataFrame, *, entity: str, ts: str) -> DataFrame:
    """Days between consecutive events of an entity: count, quartiles, mean, bands; of entities
    with a gap."""
    return gaps_of_days(daily_rollup(events, entity=entity, ts=ts, flags={}), entity=entity)


def gaps_of_days(days: DataFrame, *, entity: str) -> DataFrame:
    """The gap profile from a daily rollup."""
    profile = entity_profile(days, entity=entity).where("n_gaps IS NOT NULL")
    return profile.select(
        entity,
        "n_gaps",
        *GAP_QUARTILES,
        "gap_mean",
        "n_gap_le30",
        "n_gap_le90",
        "n_gap_gt180",
    )


def first_events(
    events: DataFrame, *, entity: str, ts: str, group: str, name: str
) -> DataFrame:
    """Index date per (entity, group): the first event that belongs to the group.

    Spark sorts its whole input to take the least of a text, so the events are reduced per name
    first, by hash, and only those rows are sorted.
    """
    per_name = events.groupBy(entity, group, name).agg(F.min(ts).alias("index_ts"))
    return per_name.groupBy(entity, group).agg(
        F.min(name).alias(name), F.min("index_ts").alias("index_ts")
    )


def follow_up(
    index: DataFrame,
    events: DataFrame,
    *,
    entity: str,
    ts: str,
    group: str,
    name: str,
    flag: str,
    days: DataFrame | None = None,
) -> DataFrame:
    """What follows each index date: next event, events within 30/90/180 days, flagged events.

    Only events strictly after the index count. The windows count midnights, so for all days after
    the index day an event's time does not matter: there the daily rollup ``days`` (with the sum of
    ``flag`` under its name; made here if not given) meets the entity's index rows, at most one row
    per calendar day however many events an entity has. Times matter on the index day alone; there raw events
    meet the index rows by (entity, day), which spreads a hot entity over its days. Both parts and
    one empty contribution per index row, which keeps rows without later events (or with a NULL
    entity) at zero, are summed by one aggregation. Joining null-safe keeps Catalyst from
    filtering some uses of the index table, which would stop it from computing that table once
    for all.
    """
    dated = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(entity).alias("e_entity"),
        F.col(ts).alias("e_ts"),
        F.to_date(ts).alias("e_day"),
        F.when(F.col(flag) == 1, 1).otherwise(0).cast("long").alias("n_flagged"),
    )
    if days is None:
        days = daily_rollup(events, entity=entity, ts=ts, flags={flag: flag})
    later = days.where(F.col(entity).isNotNull() & F.col("day").isNotNull()).select(
        F.col(entity).alias("e_entity"),
        F.col("first_ts").alias("e_ts"),
        F.col("day").alias("e_day"),
        F.col("n"),
        F.coalesce(flag, F.lit(0).cast("long")).alias("n_flagged"),
    )
    same_entity = F.col("e_entity").eqNullSafe(F.col(entity))
    index_day = F.to_date("index_ts")
    later_days = later.join(index, same_entity & (F.col("e_day") > index_day))
    index_days = dated.withColumn("n", F.lit(1).cast("long")).join(
        index,
        same_entity & (F.col("e_day") == index_day) & (F.col("e_ts") > F.col("index_ts")),
    )
    columns = [*index.columns, "e_ts", "e_day", "n", "n_flagged"]
    empty = index.select(
        *index.columns,
        F.lit(None).cast("timestamp_ntz").alias("e_ts"),
        F.lit(None).cast("date").alias("e_day"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("n_flagged"),
    )
    parts = later_days.select(columns).unionAll(index_days.select(columns)).unionAll(empty)
    elapsed = days_between(F.col("index_ts"), F.col("e_day"))

    def within(limit: int, measure: str) -> Column:
        return F.sum(F.when(elapsed <= limit, F.col(measure)).otherwise(0))

    counted = parts.groupBy(entity, group, name, "index_ts").agg(
        F.min("e_ts").alias("first_after_ts"),
        within(30, "n").alias("n_visits_30d"),
        within(90, "n").alias("n_visits_90d"),
        within(180, "n").alias("n_visits_180d"),
        within(180, "n_flagged").alias("n_ed_180d"),
    )
    return counted.select(
        entity,
        group,
        name,
        "index_ts",
        "first_after_ts",
        days_between(F.col("index_ts"), F.col("first_after_ts")).alias("days_to_next"),
        "n_visits_30d",
        "n_visits_90d",
        "n_visits_180d",
        "n_ed_180d",
    )
