"""Comparisons between exposure groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.functions.columns import DAYS_PER_YEAR, quantile, quantiles, ranked, ratio, share
from cohortrail.operators.logit import Factor, odds_ratios
from cohortrail.plans import sketches
from cohortrail.plans.tables import (
    PATIENT,
    analytic_patients,
    attach_patient,
    screened_patients,
)
from cohortrail.workspace import Workspace

SETTING_SHARES = {
    "share_ed": "n_ed",
    "share_inpatient": "n_inpatient",
    "share_opf2f": "n_opf2f",
    "share_hod": "n_hod",
    "share_obs": "n_obs",
}

# The model names of the two outcomes.
MODELS = {"any_ed": "any_ED", "any_inpat": "any_inpatient"}


def n_rows() -> Column:
    return F.count(F.lit(1))


def observed_days() -> Column:
    """Days at risk; a patient with no span, or no dates, counts one day."""
    return F.sum(F.greatest(F.col("days_observed"), F.lit(1).cast("long")))


def annual_rates() -> list[Column]:
    """Events per 365.25 observed days."""
    return [
        ratio(F.sum(events).cast("double") * F.lit(DAYS_PER_YEAR), observed_days()).alias(name)
        for name, events in (
            ("ed_per_person_year", "n_ed"),
            ("inpat_per_person_year", "n_inpatient"),
        )
    ]


def any_visit_shares() -> list[Column]:
    return [
        share(F.col("n_ed") > 0).alias("pct_any_ed"),
        share(F.col("n_inpatient") > 0).alias("pct_any_inpat"),
    ]


def transport_status_mix(ws: Workspace) -> DataFrame:
    return (
        ws["patient_transport"]
        .groupBy("transport_status")
        .agg(
            n_rows().alias("n_patients"),
            F.sum("transport_yes").alias("n_ever_yes"),
            F.sum("transport_no").alias("n_ever_no"),
        )
        .orderBy(F.col("n_patients").desc(), "transport_status")
    )


def chronic_cohort_counts(ws: Workspace) -> DataFrame:
    """Patients per index group; counted per name first, as a least text is found by sorting."""
    per_name = ws["chronic_index"].groupBy("GroupCode", "GroupName").agg(n_rows().alias("n"))
    return per_name.groupBy("GroupCode").agg(
        F.min("GroupName").alias("GroupName"), F.sum("n").alias("n_patients")
    )


def from_sketches(ws: Workspace) -> bool:
    """Whether reports are to be approximate and the sketches they merge are stored."""
    return ws.study.approx and ws.is_stored("patient_sketches")


def patient_summary_by_transport(ws: Workspace) -> DataFrame:
    """All patients; those never screened form the NULL status group."""
    if from_sketches(ws):
        return sketches.patient_summary(ws)
    return (
        analytic_patients(ws, gaps=True)
        .groupBy("transport_status")
        .agg(
            n_rows().alias("n_patients"),
            F.avg("age_proxy").alias("mean_age"),
            quantile("age_proxy", 0.5, ws.study.approx).alias("median_age"),
            F.avg("n_encounters").alias("mean_enc"),
            quantile("n_encounters", 0.5, ws.study.approx).alias("median_enc"),
            F.avg("n_ed").alias("mean_ed"),
            quantile("gap_median", 0.5, ws.study.approx).alias("median_gap_days"),
            *any_visit_shares(),
        )
        .orderBy(F.col("n_patients").desc(), "transport_status")
    )


def headline_by_transport(ws: Workspace) -> DataFrame:
    status = F.col("transport_status")
    summary = sketches.headline(ws) if from_sketches(ws) else _headline(ws)
    return summary.orderBy(
        F.coalesce(ranked(status, ws.study.compared_statuses), F.lit(99)), status
    )


def _headline(ws: Workspace) -> DataFrame:
    return (
        screened_patients(ws, gaps=True)
        .groupBy("transport_status")
        .agg(
            n_rows().alias("n_patients"),
            F.avg("n_encounters").alias("mean_enc"),
            quantile("n_encounters", 0.5, ws.study.approx).alias("median_enc"),
            F.avg("n_ed").alias("mean_ed"),
            quantile("n_ed", 0.5, ws.study.approx).alias("median_ed"),
            *any_visit_shares(),
            share(F.col("n_obs") > 0).alias("pct_any_obs"),
            F.avg("age_proxy").alias("mean_age"),
            quantile("gap_median", 0.5, ws.study.approx).alias("median_gap_days"),
            quantile("gap_q75", 0.5, ws.study.approx).alias("median_gap_q75"),
        )
    )


def setting_mix_by_transport(ws: Workspace) -> DataFrame:
    total = F.sum("n_encounters")
    return (
        screened_patients(ws)
        .groupBy("transport_status")
        .agg(
            *[ratio(F.sum(n), total).alias(name) for name, n in SETTING_SHARES.items()],
            total.alias("total_encs"),
            n_rows().alias("n_patients"),
        )
    )


def chronic_followup_by_transport(ws: Workspace) -> DataFrame:
    """Patients without a next encounter have no days_to_next and leave the pct_fu shares;
    pct_any_ed_180 keeps them, because their counts are zero."""
    followed = attach_patient(
        ws["chronic_followup"], ws["patient_transport"], ws["patients"], ws["tiger"], ws.study
    )
    status = F.coalesce("transport_status", F.lit("not_screened"))
    days = F.col("days_to_next")
    summary = followed.groupBy("GroupCode", status.alias("transport_status")).agg(
        F.min("GroupName").alias("GroupName"),
        n_rows().alias("n_patients"),
        quantiles(days, [0.25, 0.5, 0.75], ws.study.approx).alias("q"),
        share(days <= 30).alias("pct_fu_30"),
        share(days <= 90).alias("pct_fu_90"),
        share(days <= 180).alias("pct_fu_180"),
        F.avg("n_visits_90d").alias("mean_visits_90d"),
        F.avg("n_ed_180d").alias("mean_ed_180d"),
        share(F.col("n_ed_180d") > 0).alias("pct_any_ed_180"),
    )
    return summary.select(
        "GroupCode",
        "transport_status",
        "GroupName",
        "n_patients",
        F.col("q")[0].alias("days_q25"),
        F.col("q")[1].alias("days_median"),
        F.col("q")[2].alias("days_q75"),
        "pct_fu_30",
        "pct_fu_90",
        "pct_fu_180",
        "mean_visits_90d",
        "mean_ed_180d",
        "pct_any_ed_180",
    )


def annualized_rates_by_transport(ws: Workspace) -> DataFrame:
    return (
        screened_patients(ws)
        .groupBy("transport_status")
        .agg(
            n_rows().alias("n_patients"),
            F.sum("n_ed").alias("total_ed"),
            F.sum("n_encounters").alias("total_enc"),
            observed_days().alias("total_days_observed"),
            *annual_rates(),
        )
    )


def model_frame(ws: Workspace) -> DataFrame:
    """Compared patients of known age, with outcomes as 0/1 and sex in three levels."""
    sex = F.col("SexAtBirth")
    return (
        screened_patients(ws)
        .where(F.col("transport_status").isin(*ws.study.compared_statuses))
        .where(F.col("age_proxy").isNotNull())
        .select(
            PATIENT,
            (F.col("n_ed") > 0).cast("int").alias("any_ed"),
            (F.col("n_inpatient") > 0).cast("int").alias("any_inpat"),
            F.col("transport_status").alias("transport"),
            "age_proxy",
            F.when(sex.isin("Male", "Female"), sex).otherwise("Other/Unknown").alias("sex"),
        )
    )


def logit_or_transport(ws: Workspace) -> DataFrame:
    return odds_ratios(
        model_frame(ws),
        outcomes=MODELS,
        covariates=["transport", "age_proxy", "sex"],
        factors=[Factor("transport", tuple(ws.study.compared_statuses)), Factor("sex")],
    )


JOURNEY_RESULTS = {
    "journey_transport_status_mix": transport_status_mix,
    "journey_chronic_cohort_counts": chronic_cohort_counts,
    "journey_patient_summary_by_transport": patient_summary_by_transport,
}

ANALYSIS_RESULTS = {
    "an_headline_by_transport": headline_by_transport,
    "an_setting_mix_by_transport": setting_mix_by_transport,
    "an_chronic_followup_by_transport": chronic_followup_by_transport,
    "an_annualized_rates_by_transport": annualized_rates_by_transport,
    "an_logit_or_transport": logit_or_transport,
}
