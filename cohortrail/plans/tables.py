"""The derived tables: exposure, journey, gaps, index events, follow-up, patient analytic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.operators.exposure import classify_answers
from cohortrail.operators.journey import (
    daily_rollup,
    entity_profile,
    entity_summary,
    entity_totals,
    first_events,
    follow_up,
    gaps_of_days,
    rollup_with_distinct,
)
from cohortrail.operators.profile import dedup_by_key
from cohortrail.study import Study
from cohortrail.workspace import Workspace

PATIENT = "PatientDurableKey"

SETTING_FLAGS = {
    "n_ed": "IsEdVisit",
    "n_inpatient": "IsInpatientAdmission",
    "n_hospadm": "IsHospitalAdmission",
    "n_obs": "IsObservation",
    "n_opf2f": "IsOutpatientFaceToFaceVisit",
    "n_hod": "IsHospitalOutpatientVisit",
}

GAP_COLUMNS = [
    "n_gaps", "gap_median", "gap_mean", "gap_q25", "gap_q75",
    "n_gap_le30", "n_gap_le90", "n_gap_gt180",
]

DEMOGRAPHICS = [
    "BirthYearBin", "SexAtBirth", "FirstRace", "OmbRace", "OmbEthnicity",
    "MaritalStatus", "MyChartStatus", "SmokingStatus", "VitalStatus", "FipsCode",
]


def diagnosis_dedup(diagnosis: DataFrame) -> DataFrame:
    return dedup_by_key(diagnosis, "DiagnosisKey")


def patient_transport(sdoh: DataFrame, study: Study) -> DataFrame:
    asked = sdoh.where(
        (F.col("Domain") == study.domain) & F.col("DisplayName").isin(*study.questions)
    )
    return classify_answers(
        asked,
        entity=PATIENT,
        answer="AnswerText",
        yes=study.yes,
        no=study.no,
        declined=study.declined,
    )


# Distinct values of the journey table and the columns they count.
SITES = {"n_departments": "DepartmentKey", "n_providers": "ProviderDurableKey"}
JOURNEY_COUNTS = [*SITES, "n_distinct_days"]


def patient_days(encounters: DataFrame) -> DataFrame:
    """One row per patient and day, which totals, gaps, follow-up and rates are taken from."""
    return daily_rollup(encounters, entity=PATIENT, ts="encounter_ts", flags=SETTING_FLAGS)


def _journey_rows(encounters: DataFrame) -> DataFrame:
    return rollup_with_distinct(
        encounters, entity=PATIENT, ts="encounter_ts", flags=SETTING_FLAGS, distinct=SITES
    )


def patient_journey(encounters: DataFrame) -> DataFrame:
    return entity_summary(
        _journey_rows(encounters), entity=PATIENT, sums=SETTING_FLAGS, counts=JOURNEY_COUNTS
    )


def patient_totals(encounters: DataFrame) -> DataFrame:
    """The journey table without its distinct counts, which no comparison reads."""
    return entity_totals(encounters, entity=PATIENT, ts="encounter_ts", flags=SETTING_FLAGS)


def patient_gaps(days: DataFrame) -> DataFrame:
    return gaps_of_days(days, entity=PATIENT)


def _named_gaps(profile: DataFrame) -> DataFrame:
    """Gaps belong to a named patient: joined by key, they would not meet the NULL patient."""
    named = F.col(PATIENT).isNotNull()
    return profile.withColumns({c: F.when(named, F.col(c)) for c in GAP_COLUMNS})


def journey_with_gaps(encounters: DataFrame) -> DataFrame:
    """Journey and gaps of every patient from one exchange of the encounters."""
    profile = entity_profile(
        _journey_rows(encounters), entity=PATIENT, sums=SETTING_FLAGS, counts=JOURNEY_COUNTS
    )
    return _named_gaps(profile)


def totals_with_gaps(days: DataFrame) -> DataFrame:
    """The same without distinct counts, from the daily rollup."""
    return _named_gaps(entity_profile(days, entity=PATIENT, sums=SETTING_FLAGS))


def with_diagnosis(encounters: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Encounters with a known primary diagnosis; the dimension holds each key once.

    No hint: Catalyst broadcasts the dimension when its size is under the threshold, and
    otherwise adaptive execution splits the encounters of a hot diagnosis.
    """
    return encounters.join(
        diagnosis, encounters["PrimaryDiagnosisKey"] == diagnosis["DiagnosisKey"]
    )


def chronic_index(encounters: DataFrame, diagnosis: DataFrame, study: Study) -> DataFrame:
    """First encounters per (patient, diagnosis key) meet the dimension, not raw encounters.

    The semi-join names the listed keys once more. Catalyst moves it below the aggregation where
    their side is small enough to broadcast, so that unlisted encounters are never exchanged;
    beyond that the hot diagnosis is already spread by patient.
    """
    listed = diagnosis.where(F.col("GroupCode").isin(*study.group_codes))
    keys = listed.select(F.col("DiagnosisKey").alias("PrimaryDiagnosisKey"))
    firsts = (
        encounters.groupBy(PATIENT, "PrimaryDiagnosisKey")
        .agg(F.min("encounter_ts").alias("encounter_ts"))
        .join(keys, "PrimaryDiagnosisKey", "left_semi")
    )
    return first_events(
        with_diagnosis(firsts, listed),
        entity=PATIENT,
        ts="encounter_ts",
        group="GroupCode",
        name="GroupName",
    )


def chronic_followup(index: DataFrame, encounters: DataFrame, days: DataFrame) -> DataFrame:
    return follow_up(
        index,
        encounters,
        entity=PATIENT,
        ts="encounter_ts",
        group="GroupCode",
        name="GroupName",
        flag="IsEdVisit",
        days=days.withColumnRenamed("n_ed", "IsEdVisit"),
    )


def attach_patient(
    df: DataFrame, transport: DataFrame, patients: DataFrame, tiger: DataFrame, study: Study
) -> DataFrame:
    """Left-join exposure, demographics and block population; repeated keys fan out.

    The population joins the narrow patient rows first, so the wide rows keep their partitioning
    by patient and never meet on a missing block code.
    """
    t = transport.select(PATIENT, "transport_status", "transport_yes", "transport_no")
    blocks = tiger.select("FipsCode", F.col("Population").alias("block_population"))
    p = patients.select(PATIENT, *DEMOGRAPHICS).join(blocks, "FipsCode", "left")
    joined = df.join(t, PATIENT, "left").join(p, PATIENT, "left")
    return joined.select(
        *df.columns,
        "transport_status",
        "transport_yes",
        "transport_no",
        *DEMOGRAPHICS,
        (F.lit(study.reference_year) - F.col("BirthYearBin")).alias("age_proxy"),
        "block_population",
    )


def patient_analytic(
    journey: DataFrame,
    gaps: DataFrame,
    transport: DataFrame,
    patients: DataFrame,
    tiger: DataFrame,
    study: Study,
) -> DataFrame:
    """One wide row per patient of the journey table, the NULL patient included.

    Journey, gaps and transport end partitioned by patient, so their joins add no exchange.
    """
    g = gaps.select(PATIENT, *GAP_COLUMNS)
    return attach_patient(journey.join(g, PATIENT, "left"), transport, patients, tiger, study)


def _analytic(ws: Workspace) -> DataFrame:
    """From stored journey and gap tables, or from one pass over the encounters."""
    attributes = ws["patient_transport"], ws["patients"], ws["tiger"], ws.study
    if ws.is_stored("patient_journey") and ws.is_stored("patient_gaps"):
        return patient_analytic(ws["patient_journey"], ws["patient_gaps"], *attributes)
    return attach_patient(journey_with_gaps(ws["encounters"]), *attributes)


def screened_only(df: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of patients with an exposure status.

    Without a hint: Catalyst moves this semi-join below the aggregation that made ``df`` where the
    exposure table is small enough to broadcast, so that other patients' events are neither added up
    nor exchanged. Beyond that it stays above, on rows of patients or days.
    """
    status = ws["patient_transport"].where(F.col("transport_status").isNotNull())
    return df.join(status.select(PATIENT), PATIENT, "left_semi")


def analytic_patients(ws: Workspace, screened: bool = False, gaps: bool = False) -> DataFrame:
    """The patient analytic table as the comparisons read it, optionally screened patients only.

    From the stored table if there is one. Otherwise assembled without the distinct counts, and
    with gap columns only if asked for: the encounters' partial sums per patient, or per patient
    and day, are exchanged, by one plan whatever the sizes.
    """
    if ws.is_stored("patient_analytic"):
        analytic = ws["patient_analytic"]
    else:
        rows = ws["patient_days"] if gaps else patient_totals(ws["encounters"])
        rows = screened_only(rows, ws) if screened else rows
        summary = totals_with_gaps(rows) if gaps else rows
        analytic = attach_patient(
            summary, ws["patient_transport"], ws["patients"], ws["tiger"], ws.study
        )
    return analytic.where(F.col("transport_status").isNotNull()) if screened else analytic


def screened_patients(ws: Workspace, gaps: bool = False) -> DataFrame:
    """The patients with an exposure status."""
    return analytic_patients(ws, screened=True, gaps=gaps)


DERIVED = {
    "diagnosis_dedup": lambda ws: diagnosis_dedup(ws["diagnosis"]),
    "patient_days": lambda ws: patient_days(ws["encounters"]),
    "patient_transport": lambda ws: patient_transport(ws["sdoh"], ws.study),
    "patient_journey": lambda ws: patient_journey(ws["encounters"]),
    "patient_gaps": lambda ws: patient_gaps(ws["patient_days"]),
    "chronic_index": lambda ws: chronic_index(ws["encounters"], ws["diagnosis_dedup"], ws.study),
    "chronic_followup": lambda ws: chronic_followup(
        ws["chronic_index"], ws["encounters"], ws["patient_days"]
    ),
    "patient_analytic": _analytic,
}
