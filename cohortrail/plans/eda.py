"""Descriptive tables over encounters, questionnaire answers and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.operators.audit import key_overlap, match_audit
from cohortrail.operators.profile import distribution, grouped_counts, top_groups
from cohortrail.plans import sketches
from cohortrail.plans.tables import PATIENT, with_diagnosis
from cohortrail.workspace import Workspace


def _top_diagnoses(ws: Workspace, code: str, name: str, k: int) -> DataFrame:
    """The k codes with most encounters, their name and their distinct patients.

    Encounters are counted per (diagnosis key, patient) before the dimension is joined, so a hot
    diagnosis is spread by patient and one row per patient there. The counts of the k codes come
    from the same rows again, which Spark then shuffles once; k rows may be broadcast.
    """
    known = ws["diagnosis_dedup"].where(F.col(code).isNotNull())
    pairs = ws["encounters"].groupBy("PrimaryDiagnosisKey", PATIENT).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_key = pairs.groupBy("PrimaryDiagnosisKey").agg(F.sum("n").alias("n"))
    per_code = with_diagnosis(per_key, known).groupBy(code).agg(
        F.min(name).alias(name), F.sum("n").alias("total")
    )
    top = per_code.orderBy(F.col("total").desc(), code).limit(k)
    top_keys = known.select("DiagnosisKey", code).join(F.broadcast(top.select(code)), code)
    per_patient = with_diagnosis(pairs, top_keys).groupBy(code, PATIENT).agg(F.sum("n").alias("n"))
    counts = per_patient.groupBy(code).agg(
        F.sum("n").alias("n_enc"), F.count(PATIENT).alias("n_patients")
    )
    return (
        top.join(counts, code)
        .select(code, name, "n_enc", "n_patients")
        .orderBy(F.col("n_enc").desc(), code)
    )


def top_diag_groups(ws: Workspace) -> DataFrame:
    return _top_diagnoses(ws, "GroupCode", "GroupName", 40)


def top_diag_values(ws: Workspace) -> DataFrame:
    return _top_diagnoses(ws, "DiagnosisValue", "DiagnosisName", 60)


def encounters_by_year(ws: Workspace) -> DataFrame:
    flags = {
        "n_ed": "IsEdVisit",
        "n_hospadm": "IsHospitalAdmission",
        "n_inpat": "IsInpatientAdmission",
        "n_opf2f": "IsOutpatientFaceToFaceVisit",
        "n_hod": "IsHospitalOutpatientVisit",
    }
    year = F.year("encounter_ts").cast("long")
    return (
        ws["encounters"]
        .groupBy(year.alias("yr"))
        .agg(
            F.count(F.lit(1)).alias("n_enc"),
            *[F.sum(flag).alias(name) for name, flag in flags.items()],
        )
        .orderBy(F.col("yr").asc_nulls_last())
    )


def encounters_by_depttype(ws: Workspace) -> DataFrame:
    """Left join on department, after encounters are counted per (department, patient): a hot or
    NULL department is spread by patient before it meets the dimension. The few department types
    share many encounters, so patients are counted through (type, patient) rows."""
    departments = ws["departments"].select("DepartmentKey", "DepartmentType")
    pairs = ws["encounters"].groupBy("DepartmentKey", PATIENT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("IsEdVisit").alias("n_ed")
    )
    per_patient = (
        pairs.join(departments, "DepartmentKey", "left")
        .groupBy("DepartmentType", PATIENT)
        .agg(F.sum("n").alias("n"), F.sum("n_ed").alias("n_ed"))
    )
    counted = per_patient.groupBy("DepartmentType").agg(
        F.sum("n").alias("n_enc"), F.count(PATIENT).alias("n_patients"), F.sum("n_ed").alias("n_ed")
    )
    return counted.orderBy(F.col("n_enc").desc(), F.col("DepartmentType").asc_nulls_last())


def sdoh_domain_coverage(ws: Workspace) -> DataFrame:
    return grouped_counts(
        ws["sdoh"],
        [F.coalesce("Domain", F.lit("(missing)")).alias("Domain")],
        [F.count_distinct(PATIENT).alias("n_patients")],
        "n_rows",
    )


def sdoh_patients_per_domain(ws: Workspace) -> DataFrame:
    return (
        ws["sdoh"]
        .where(F.col("Domain").isNotNull())
        .groupBy("Domain")
        .agg(F.count_distinct(PATIENT).alias("n_patients"))
        .orderBy(F.col("n_patients").desc(), "Domain")
    )


def fips_coverage(ws: Workspace) -> DataFrame:
    fips = F.col("FipsCode")
    missing = fips.isNull() | (fips == "") | fips.startswith("*")
    state = F.when(missing, "unspecified").otherwise("fips_present")
    return (
        ws["patients"]
        .groupBy(state.alias("fips_state"))
        .agg(F.count(F.lit(1)).alias("n_patients"))
    )


def fips_tiger_match(ws: Workspace) -> DataFrame:
    fips = F.col("FipsCode")
    coded = ws["patients"].where(fips.isNotNull() & ~fips.startswith("*") & (fips != ""))
    return match_audit(coded, "FipsCode", ws["tiger"], "FipsCode").select(
        F.col("n_rows").alias("n_patients_with_fips"), F.col("n_unmatched").alias("n_without_tiger")
    )


def patients_by_birthyearbin(ws: Workspace) -> DataFrame:
    return (
        ws["patients"]
        .groupBy("BirthYearBin")
        .agg(F.count(F.lit(1)).alias("n_patients"))
        .orderBy(F.col("BirthYearBin").asc_nulls_last())
    )


def enc_per_patient(ws: Workspace) -> DataFrame:
    if ws.study.approx and ws.is_stored("patient_sketches"):
        return sketches.encounters_per_patient(ws)
    per_patient = ws["encounters"].groupBy(PATIENT).agg(F.count(F.lit(1)).alias("n_enc"))
    return distribution(per_patient, "n_enc", "n_patients", ws.study.approx)


def sdoh_encounter_overlap(ws: Workspace) -> DataFrame:
    answered = ws["sdoh"].where(F.col(PATIENT).isNotNull())
    return key_overlap(answered, ws["encounters"], PATIENT).select(
        F.col("n_left").alias("n_patients_any_sdoh"),
        F.col("n_right").alias("n_patients_any_enc"),
        F.col("n_both").alias("n_overlap"),
    )


def transportation_answers(ws: Workspace) -> DataFrame:
    return top_groups(
        ws["sdoh"].where(F.col("Domain") == ws.study.domain),
        by=["DisplayName", "AnswerText"],
        count="n",
        k=30,
    )


EDA_RESULTS = {
    "eda_top_diag_groups": top_diag_groups,
    "eda_top_diag_values": top_diag_values,
    "eda_encounters_by_year": encounters_by_year,
    "eda_encounters_by_depttype": encounters_by_depttype,
    "eda_sdoh_domain_coverage": sdoh_domain_coverage,
    "eda_sdoh_patients_per_domain": sdoh_patients_per_domain,
    "eda_fips_coverage": fips_coverage,
    "eda_fips_tiger_match": fips_tiger_match,
    "eda_patients_by_birthyearbin": patients_by_birthyearbin,
    "eda_enc_per_patient": enc_per_patient,
    "eda_sdoh_encounter_overlap": sdoh_encounter_overlap,
    "eda_transportation_answers": transportation_answers,
}
