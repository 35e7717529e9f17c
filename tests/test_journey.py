"""Per-patient summaries on small event tables, and the traps between engines."""

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from cohortrail.operators.journey import first_events, follow_up, gap_profile
from cohortrail.plans.tables import patient_analytic, patient_journey
from cohortrail.study import Study

EVENTS = "p long, ts timestamp_ntz"


def at(text):
    return datetime.fromisoformat(text)


def gaps(spark, rows):
    df = gap_profile(spark.createDataFrame(rows, EVENTS), entity="p", ts="ts")
    return {r.p: r for r in df.collect()}


def test_undated_events_make_no_gap(spark):
    rows = [(1, None), (1, at("2022-01-01")), (1, at("2022-01-03"))]
    assert gaps(spark, rows)[1].n_gaps == 1


def test_gap_counts_midnights(spark):
    rows = [(1, at("2022-01-01T23:00")), (1, at("2022-01-02T01:00"))]
    assert gaps(spark, rows)[1].gap_median == 1.0


def test_single_event_has_no_profile(spark):
    assert gaps(spark, [(1, at("2022-01-01")), (2, None)]) == {}


def test_quartiles_interpolate(spark):
    days = ["2022-01-01", "2022-01-02", "2022-01-04", "2022-01-07", "2022-01-17"]
    row = gaps(spark, [(1, at(d)) for d in days])[1]
    assert (row.gap_q25, row.gap_median, row.gap_q75) == (1.75, 2.5, 4.75)


def test_gap_profile_equals_brute_force(spark):
    """Random patients, a NULL patient, tied and undated events, and one very busy patient."""
    rng = np.random.default_rng(3)
    rows = []
    for p in [None, *range(40)]:
        for _ in range(4000 if p == 0 else int(rng.integers(1, 30))):
            ts = at("2022-01-01") + timedelta(minutes=int(rng.integers(0, 60 * 24 * 900)))
            rows.append((p, None if rng.random() < 0.1 else ts))
    by_patient = defaultdict(list)
    for p, ts in rows:
        if ts is not None:
            by_patient[p].append(ts)
    found = gaps(spark, rows)
    for p, stamps in by_patient.items():
        stamps.sort()
        g = [(b.date() - a.date()).days for a, b in zip(stamps, stamps[1:])]
        if not g:
            assert p not in found
            continue
        row = found[p]
        assert row.n_gaps == len(g)
        assert [row.gap_q25, row.gap_median, row.gap_q75] == pytest.approx(
            np.quantile(g, [0.25, 0.5, 0.75]).tolist()
        )
        assert row.gap_mean == pytest.approx(np.mean(g))
        assert row.n_gap_le30 == sum(x <= 30 for x in g)
        assert row.n_gap_le90 == sum(x <= 90 for x in g)
        assert row.n_gap_gt180 == sum(x > 180 for x in g)


def test_busy_patient_is_reduced_to_days_before_the_window(spark):
    """The window sorts one row per day, however many events a patient has on it."""
    rows = [(1, at("2022-01-01") + timedelta(minutes=i)) for i in range(3000)]
    df = gap_profile(spark.createDataFrame(rows, EVENTS), entity="p", ts="ts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window [")
    assert "HashAggregate(keys=[p" in plan[window:]
    assert df.first().n_gaps == 2999


def test_days_are_sorted_by_gap_without_a_table_by_hash(spark):
    """Between the days of a patient and its profile stand two sorts, and no aggregate by gap, which
    held the rows of a task twice more."""
    rows = [(p, at("2022-01-01") + timedelta(days=p * i * i)) for p in (1, 2) for i in range(9)]
    df = gap_profile(spark.createDataFrame(rows, EVENTS), entity="p", ts="ts")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in lines if "Aggregate(keys=[p" in line and "gap" in line.split("]")[0]]
    assert len([line for line in lines if "Sort [p" in line]) == 2
    assert {r.p: r.gap_median for r in df.collect()} == {1: 8.0, 2: 16.0}


def test_equal_gaps_and_zero_gaps_keep_their_ranks(spark):
    """Ties of gaps, zeros of days with several events, a NULL patient and undated events."""
    days = [0, 0, 0, 3, 6, 9, 9, 40, 300]
    rows = [(p, at("2022-01-01") + timedelta(days=d)) for p in (None, 4) for d in days]
    for row in gaps(spark, [*rows, (None, None), (4, None), (4, None)]).values():
        # 0 0 0 3 3 3 31 260
        assert (row.n_gaps, row.gap_q25, row.gap_median, row.gap_q75) == (8, 0.0, 3.0, 10.0)
        assert (row.gap_mean, row.n_gap_le30, row.n_gap_le90, row.n_gap_gt180) == (37.5, 6, 7, 1)


INDEX_EVENTS = "p long, g string, name string, ts timestamp_ntz, ed int"


def followed(spark, rows):
    events = spark.createDataFrame(rows, INDEX_EVENTS)
    index = first_events(events.where("g IS NOT NULL"), entity="p", ts="ts", group="g", name="name")
    out = follow_up(
        index, events, entity="p", ts="ts", group="g", name="name", flag="ed"
    ).collect()
    return {(r.p, r.g): r for r in out}


def test_same_time_is_not_follow_up(spark):
    rows = [
        (1, "A", "a", at("2022-01-01T10:00"), 0),
        (1, None, None, at("2022-01-01T10:00"), 1),
    ]
    row = followed(spark, rows)[(1, "A")]
    assert row.first_after_ts is None
    assert row.days_to_next is None
    assert row.n_visits_30d == 0
    assert row.n_ed_180d == 0


def test_later_on_the_index_day_counts(spark):
    rows = [
        (1, "A", "a", at("2022-01-01T10:00"), 0),
        (1, None, None, at("2022-01-01T11:00"), 1),
        (1, None, None, at("2022-06-30T09:00"), 1),
        (1, None, None, at("2022-07-01T09:00"), 1),
    ]
    row = followed(spark, rows)[(1, "A")]
    assert row.days_to_next == 0
    assert (row.n_visits_30d, row.n_visits_90d, row.n_visits_180d) == (1, 1, 2)
    assert row.n_ed_180d == 2


def test_null_patient_and_undated_index_keep_zero_rows(spark):
    rows = [
        (None, "A", "a", at("2022-01-01"), 0),
        (None, None, None, at("2022-01-02"), 1),
        (2, "A", "a", None, 0),
        (2, None, None, at("2022-01-02"), 1),
    ]
    found = followed(spark, rows)
    for key in ((None, "A"), (2, "A")):
        assert found[key].n_visits_180d == 0
        assert found[key].first_after_ts is None


def test_follow_up_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in range(30):
        for _ in range(2000 if p == 0 else 20):
            g = rng.choice(["A", "B", None])
            ts = at("2022-01-01") + timedelta(hours=int(rng.integers(0, 24 * 600)))
            rows.append((p, g, g and g.lower(), ts, int(rng.random() < 0.2)))
    found = followed(spark, rows)
    for (p, g), row in found.items():
        mine = [r for r in rows if r[0] == p]
        start = min(r[3] for r in mine if r[1] == g)
        later = [((r[3].date() - start.date()).days, r) for r in mine if r[3] > start]
        assert row.index_ts == start
        assert row.first_after_ts == min((r[3] for _, r in later), default=None)
        for days in (30, 90, 180):
            assert row[f"n_visits_{days}d"] == sum(d <= days for d, _ in later)
        assert row.n_ed_180d == sum(d <= 180 and r[4] == 1 for d, r in later)


ENCOUNTERS = (
    "PatientDurableKey long, encounter_ts timestamp_ntz, DepartmentKey long, "
    "ProviderDurableKey long, IsEdVisit int, IsInpatientAdmission int, IsHospitalAdmission int, "
    "IsObservation int, IsOutpatientFaceToFaceVisit int, IsHospitalOutpatientVisit int"
)


def test_journey_keeps_the_null_patient(spark):
    rows = [
        (None, at("2022-01-01T10:00"), 1, 1, 1, 0, 0, 0, 0, 0),
        (None, at("2022-01-01T23:00"), 2, None, 0, 1, 0, 0, 0, 0),
        (None, at("2022-01-03T01:00"), 2, 1, 1, 0, 0, 0, 0, 0),
        (7, None, None, None, 0, 0, 0, 0, 0, 0),
    ]
    out = {
        r.PatientDurableKey: r
        for r in patient_journey(spark.createDataFrame(rows, ENCOUNTERS)).collect()
    }
    assert len(out) == 2
    null = out[None]
    assert (null.n_encounters, null.n_ed, null.n_inpatient) == (3, 2, 1)
    assert (null.n_departments, null.n_providers, null.n_distinct_days) == (2, 1, 2)
    assert null.days_observed == 2
    assert out[7].n_distinct_days == 0
    assert out[7].first_ts is None


def test_analytic_table_passes_all_attributes_and_fans_out(spark):
    journey = spark.createDataFrame([(1, 3), (None, 2)], "PatientDurableKey long, n_encounters long")
    gap_row = (1, 2, 1.0, 1.0, 1.0, 1.0, 2, 2, 0)
    gaps_df = spark.createDataFrame(
        [gap_row],
        "PatientDurableKey long, n_gaps long, gap_median double, gap_mean double, gap_q25 double, "
        "gap_q75 double, n_gap_le30 long, n_gap_le90 long, n_gap_gt180 long",
    )
    transport = spark.createDataFrame(
        [(1, "barrier", 1, 0)],
        "PatientDurableKey long, transport_status string, transport_yes int, transport_no int",
    )
    patients = spark.createDataFrame(
        [(1, 1970, "Male", "r", "o", "e", "m", "c", "s", "v", "0123")],
        "PatientDurableKey long, BirthYearBin int, SexAtBirth string, FirstRace string, "
        "OmbRace string, OmbEthnicity string, MaritalStatus string, MyChartStatus string, "
        "SmokingStatus string, VitalStatus string, FipsCode string",
    )
    tiger = spark.createDataFrame([("0123", 10), ("0123", 20)], "FipsCode string, Population int")
    rows = patient_analytic(journey, gaps_df, transport, patients, tiger, Study()).collect()
    assert sorted(r.block_population for r in rows if r.PatientDurableKey == 1) == [10, 20]
    one = next(r for r in rows if r.PatientDurableKey == 1)
    assert (one.age_proxy, one.VitalStatus, one.transport_status) == (56, "v", "barrier")
    null = next(r for r in rows if r.PatientDurableKey is None)
    assert null.transport_status is None
    assert null.n_encounters == 2
