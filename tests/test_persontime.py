"""Person-time by calendar period."""

from datetime import date, datetime

import pytest

from cohortrail.operators.persontime import Calendar, person_time_rates

COHORT = "p long, cohort int, first_ts timestamp_ntz, last_ts timestamp_ntz"
EVENTS = "p long, ts timestamp_ntz, ed int"


def rates(spark, cohort, events, months=12, years=(2022, 2023)):
    df = person_time_rates(
        spark.createDataFrame(cohort, COHORT),
        spark.createDataFrame(events, EVENTS),
        Calendar(*years, months),
        entity="p", label="cohort", ts="ts", flag="ed",
    )
    return {(r.cohort, r.period_start): r for r in df.collect()}


def test_both_end_days_count(spark):
    found = rates(
        spark, [(1, 1, datetime(2022, 12, 31, 23), datetime(2023, 1, 2, 1))],
        [(1, datetime(2022, 12, 31, 23), 1), (1, datetime(2023, 1, 2, 1), 0)],
    )
    first, second = found[1, date(2022, 1, 1)], found[1, date(2023, 1, 1)]
    assert first.person_years == pytest.approx(1 / 365.25)
    assert second.person_years == pytest.approx(2 / 365.25)
    assert first.value == pytest.approx(365.25)
    assert (first.n_events, second.n_events) == (1, 0)
    assert second.value == 0.0
    assert (first.pct_any, second.pct_any) == (1.0, 0.0)


def test_period_without_anyone_stays_with_null_rate(spark):
    found = rates(spark, [(1, 1, datetime(2022, 2, 1), datetime(2022, 3, 1))], [])
    empty = found[1, date(2023, 1, 1)]
    assert empty.person_years == 0.0
    assert empty.value is None
    assert (empty.n_events, empty.n_patients) == (0, 1)


def test_unknown_bounds_count_every_whole_period(spark):
    found = rates(spark, [(1, 1, None, None)], [], months=3, years=(2022, 2022))
    assert len(found) == 4
    assert found[1, date(2022, 1, 1)].person_years == pytest.approx(90 / 365.25)
    assert found[1, date(2022, 10, 1)].person_years == pytest.approx(92 / 365.25)


def test_repeated_member_counts_twice_but_is_one_patient_with_events(spark):
    member = (1, 1, datetime(2022, 1, 1), datetime(2022, 1, 10))
    found = rates(spark, [member, member], [(1, datetime(2022, 1, 5), 1)])
    row = found[1, date(2022, 1, 1)]
    assert (row.n_events, row.n_patients) == (2, 2)
    assert row.person_years == pytest.approx(20 / 365.25)
    assert row.pct_any == 0.5


def test_events_outside_the_calendar_or_cohort_are_ignored(spark):
    found = rates(
        spark, [(1, 1, datetime(2021, 1, 1), datetime(2024, 6, 1))],
        [(1, datetime(2021, 12, 31, 23, 59), 1), (1, datetime(2024, 1, 1), 1),
         (1, datetime(2023, 12, 31, 23, 59), 1), (2, datetime(2022, 1, 1), 1), (1, None, 1)],
    )
    assert [found[1, date(y, 1, 1)].n_events for y in (2022, 2023)] == [0, 1]


def test_quarters_cover_the_years(spark):
    starts = spark.range(1).select(Calendar(2022, 2025, 3).starts().alias("s")).first().s
    assert len(starts) == 16 == Calendar(2022, 2025, 3).size
    assert (starts[0], starts[-1]) == (date(2022, 1, 1), date(2025, 10, 1))
