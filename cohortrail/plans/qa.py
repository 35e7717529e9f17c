"""Load checks: row counts, duplicate keys, join audits, ranges and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.operators.audit import duplicate_keys, match_audit, table_counts
from cohortrail.operators.profile import grouped_counts
from cohortrail.workspace import Workspace

SOURCE_TABLES = [
    "departments", "diagnosis", "encounters", "patients", "providers", "sdoh", "tiger",
]


def row_counts(ws: Workspace) -> DataFrame:
    return table_counts({name: ws[name] for name in SOURCE_TABLES})


def dup_encounter(ws: Workspace) -> DataFrame:
    return duplicate_keys(ws["encounters"], "EncounterKey")


def diag_join(ws: Workspace) -> DataFrame:
    """Against the raw diagnosis table: repeated keys fan out and n_enc can exceed the rows."""
    audit = match_audit(ws["encounters"], "PrimaryDiagnosisKey", ws["diagnosis"], "DiagnosisKey")
    return audit.select(
        F.col("n_rows").alias("n_enc"), "n_null_key", "n_unmatched_nonnull", "n_matched"
    )


def patient_join(ws: Workspace) -> DataFrame:
    audit = match_audit(
        ws["encounters"], "PatientDurableKey", ws["patients"], "PatientDurableKey"
    )
    return audit.select(F.col("n_rows").alias("n_enc"), "n_unmatched")


def dept_join(ws: Workspace) -> DataFrame:
    audit = match_audit(ws["encounters"], "DepartmentKey", ws["departments"], "DepartmentKey")
    return audit.select(F.col("n_rows").alias("n_enc"), "n_unmatched")


def sdoh_enc_join(ws: Workspace) -> DataFrame:
    audit = match_audit(ws["sdoh"], "EncounterKey", ws["encounters"], "EncounterKey")
    return audit.select(
        F.col("n_rows").alias("n_sdoh_rows"), F.col("n_unmatched").alias("n_unmatched_encounter")
    )


def date_range(ws: Workspace) -> DataFrame:
    ts = F.col("encounter_ts")
    return ws["encounters"].agg(
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        F.count_if(ts.isNull()).alias("n_missing_ts"),
        F.count(F.lit(1)).alias("n"),
    )


def type_mix(ws: Workspace) -> DataFrame:
    return grouped_counts(ws["encounters"], [F.col("Type")], [], "n")


def bool_mix(ws: Workspace) -> DataFrame:
    flags = {
        "n_ed": "IsEdVisit",
        "n_hosp_adm": "IsHospitalAdmission",
        "n_hod": "IsHospitalOutpatientVisit",
        "n_inpatient": "IsInpatientAdmission",
        "n_obs": "IsObservation",
        "n_opf2f": "IsOutpatientFaceToFaceVisit",
    }
    return ws["encounters"].agg(
        *[F.sum(flag).alias(name) for name, flag in flags.items()],
        F.count(F.lit(1)).alias("n_total"),
    )


QA_RESULTS = {
    "qa_row_counts": row_counts,
    "qa_dup_encounter": dup_encounter,
    "qa_diag_join": diag_join,
    "qa_patient_join": patient_join,
    "qa_dept_join": dept_join,
    "qa_sdoh_enc_join": sdoh_enc_join,
    "qa_date_range": date_range,
    "qa_type_mix": type_mix,
    "qa_bool_mix": bool_mix,
}
