"""Emergency visits per person-year by calendar year and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.functions.columns import ranked
from cohortrail.operators.persontime import (
    Calendar,
    observed_entities,
    person_time_rates,
    rates_of_members,
)
from cohortrail.plans.tables import PATIENT, screened_only, screened_patients
from cohortrail.workspace import Workspace

METRIC = "ed_per_person_year"


def _rates(ws: Workspace, months: int) -> DataFrame:
    """Rates per period and cohort; cohorts go by number until the rows are few.

    With a stored patient table the cohort's dates come from there, and counts from the stored days
    or else the encounters, which date and flag filters reach. Without, dates and counts come from
    one scan of the encounters.
    """
    study = ws.study
    calendar = Calendar(study.first_year, study.last_year, months)
    columns = {"entity": PATIENT, "ts": "encounter_ts", "flag": "IsEdVisit"}
    of_days = {"entity": PATIENT, "ts": "first_ts", "flag": "n_ed", "summed": True}
    status = F.col("transport_status")
    number = ranked(status, study.compared_statuses).alias("number")
    if ws.is_stored("patient_analytic"):
        members = screened_patients(ws).where(status.isin(*study.compared_statuses))
        cohort = members.select(PATIENT, number, "first_ts", "last_ts")
        events, named = (
            (ws["patient_days"], of_days)
            if ws.is_stored("patient_days")
            else (ws["encounters"], columns)
        )
        rates = person_time_rates(cohort, events, calendar, label="number", **named)
    else:
        compared = ws["patient_transport"].where(status.isin(*study.compared_statuses))
        observed = screened_only(observed_entities(ws["encounters"], calendar, **columns), ws)
        # A patient counts as often as the analytic table has it: per listing and block.
        blocks = ws["tiger"].select("FipsCode")
        listed = ws["patients"].select(PATIENT, "FipsCode").join(blocks, "FipsCode", "left")
        listed = listed.groupBy(PATIENT).agg(F.count(F.lit(1)).alias("rows"))
        members = (
            observed.join(compared.select(PATIENT, number), PATIENT)
            .join(listed, PATIENT, "left")
            .withColumn("times", F.coalesce("rows", F.lit(1).cast("long")))
        )
        rates = rates_of_members(members, calendar, label="number")
    names = F.array(*[F.lit(name) for _, name in study.compared])
    return rates.withColumn("cohort", F.element_at(names, F.col("number")))


def _measures() -> list:
    return [
        "cohort",
        F.lit(METRIC).alias("metric"),
        "value",
        F.col("n_events").alias("n_ed"),
        "person_years",
        "n_patients",
        F.col("pct_any").alias("pct_any_ed"),
    ]


def ed_by_year(ws: Workspace) -> DataFrame:
    return (
        _rates(ws, 12)
        .select(F.year("period_start").alias("year"), *_measures())
        .orderBy("cohort", "year")
    )


def ed_by_quarter(ws: Workspace) -> DataFrame:
    start = F.col("period_start")
    year, quarter = F.year(start), F.quarter(start)
    return (
        _rates(ws, 3)
        .select(
            year.alias("year"),
            quarter.alias("quarter"),
            "period_start",
            (year.cast("double") + (quarter.cast("double") - 1) / 4).alias("t"),
            F.concat(F.date_format(start, "yy"), F.lit(" Q"), quarter).alias("period_label"),
            *_measures(),
        )
        .orderBy("cohort", "year", "quarter")
    )


def line_chart_axis(series: DataFrame, x: str, pad_share: float | None) -> DataFrame:
    """Axis limits of a rate line chart.

    y runs from 95 % of the lowest value, not below zero, to 108 % of the highest. x is padded by
    a share of its range, or by 0.15 where no share is given.
    """
    value, at = F.col("value"), F.col(x).cast("double")
    pad = F.lit(0.15) if pad_share is None else (F.max(at) - F.min(at)) * pad_share
    return series.agg(
        (F.min(at) - pad).alias("x_min"),
        (F.max(at) + pad).alias("x_max"),
        F.greatest(F.lit(0.0), F.min(value) * 0.95).alias("y_min"),
        (F.max(value) * 1.08).alias("y_max"),
    )


# The x column of each series and how its axis is padded.
SERIES_AXES = {"ed_by_year": ("year", None), "ed_by_quarter": ("t", 0.02)}

SERIES = {
    "ed_by_year": ed_by_year,
    "ed_by_quarter": ed_by_quarter,
    "ed_by_year_axis": lambda ws: line_chart_axis(ed_by_year(ws), *SERIES_AXES["ed_by_year"]),
    "ed_by_quarter_axis": lambda ws: line_chart_axis(
        ed_by_quarter(ws), *SERIES_AXES["ed_by_quarter"]
    ),
}
