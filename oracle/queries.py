"""One DuckDB query per registered result, over the raw test tables."""

from __future__ import annotations

from oracle.logit import LOGIT_TABLE
from oracle.views import SOURCES, with_views

STATUSES = "('no_barrier', 'barrier')"
STATUS_ORDER = "CASE transport_status WHEN 'no_barrier' THEN 1 WHEN 'barrier' THEN 2 END"
COHORT = (
    "CASE transport_status WHEN 'no_barrier' THEN 'No transport barrier' "
    "WHEN 'barrier' THEN 'Transport barrier' END"
)
STATUS_LAB = f"{COHORT} || chr(10) || '(n = ' || format('{{:,}}', n_patients) || ')'"


def left_join_audit(left: str, left_key: str, right: str, right_key: str, columns: str) -> str:
    return f"""
SELECT {columns}
FROM (SELECT {left_key} AS lk FROM {left}) a
LEFT JOIN (SELECT {right_key} AS rk FROM {right}) b ON a.lk = b.rk"""


def top_diagnoses(code: str, name: str, k: int) -> str:
    return f"""
SELECT {code}, min({name}) AS {name}, count(*) AS n_enc,
       count(DISTINCT PatientDurableKey) AS n_patients
FROM encounters JOIN diagnosis_dedup ON PrimaryDiagnosisKey = DiagnosisKey
WHERE {code} IS NOT NULL GROUP BY {code} ORDER BY n_enc DESC, {code} LIMIT {k}"""


def whole(table: str) -> str:
    return f"SELECT * FROM {table}"


HEADLINE = """
SELECT transport_status, count(*) AS n_patients,
       round(avg(n_encounters), 6) AS mean_enc, quantile_cont(n_encounters, 0.5) AS median_enc,
       round(avg(n_ed), 6) AS mean_ed, quantile_cont(n_ed, 0.5) AS median_ed,
       round(avg(CAST(n_ed > 0 AS INTEGER)), 6) AS pct_any_ed,
       round(avg(CAST(n_inpatient > 0 AS INTEGER)), 6) AS pct_any_inpat,
       round(avg(CAST(n_obs > 0 AS INTEGER)), 6) AS pct_any_obs,
       round(avg(age_proxy), 6) AS mean_age,
       quantile_cont(gap_median, 0.5) AS median_gap_days,
       quantile_cont(gap_q75, 0.5) AS median_gap_q75
FROM patient_analytic WHERE transport_status IS NOT NULL GROUP BY transport_status"""

RATES = """
SELECT transport_status, count(*) AS n_patients,
       CAST(sum(n_ed) AS BIGINT) AS total_ed, CAST(sum(n_encounters) AS BIGINT) AS total_enc,
       CAST(sum(greatest(days_observed, 1)) AS BIGINT) AS total_days_observed,
       round(sum(n_ed) * 365.25::DOUBLE / sum(greatest(days_observed, 1)), 6) AS ed_per_person_year,
       round(sum(n_inpatient) * 365.25::DOUBLE / sum(greatest(days_observed, 1)), 6)
         AS inpat_per_person_year
FROM patient_analytic WHERE transport_status IS NOT NULL GROUP BY transport_status"""

SETTING_MIX = """
SELECT transport_status,
       sum(n_ed)::DOUBLE / sum(n_encounters) AS share_ed,
       sum(n_inpatient)::DOUBLE / sum(n_encounters) AS share_inpatient,
       sum(n_opf2f)::DOUBLE / sum(n_encounters) AS share_opf2f,
       sum(n_hod)::DOUBLE / sum(n_encounters) AS share_hod,
       sum(n_obs)::DOUBLE / sum(n_encounters) AS share_obs,
       CAST(sum(n_encounters) AS BIGINT) AS total_encs, count(*) AS n_patients
FROM patient_analytic WHERE transport_status IS NOT NULL GROUP BY transport_status"""

CHRONIC = """
SELECT GroupCode, coalesce(transport_status, 'not_screened') AS transport_status,
       min(GroupName) AS GroupName, count(*) AS n_patients,
       quantile_cont(days_to_next, 0.25) AS days_q25,
       quantile_cont(days_to_next, 0.5) AS days_median,
       quantile_cont(days_to_next, 0.75) AS days_q75,
       round(avg(CAST(days_to_next <= 30 AS INTEGER)), 6) AS pct_fu_30,
       round(avg(CAST(days_to_next <= 90 AS INTEGER)), 6) AS pct_fu_90,
       round(avg(CAST(days_to_next <= 180 AS INTEGER)), 6) AS pct_fu_180,
       round(avg(n_visits_90d), 6) AS mean_visits_90d, round(avg(n_ed_180d), 6) AS mean_ed_180d,
       avg(CAST(n_ed_180d > 0 AS INTEGER)) AS pct_any_ed_180
FROM chronic_followup LEFT JOIN patient_analytic USING (PatientDurableKey)
GROUP BY GroupCode, coalesce(transport_status, 'not_screened')"""

SIGNATURE = f"""
SELECT metric_order, metric, {STATUS_ORDER} AS status_order, transport_status,
       {STATUS_LAB} AS status_lab, round(value, 6) AS value,
       CASE WHEN metric LIKE '\\%%' ESCAPE '\\' THEN printf('%.0f%%', 100 * value)
            ELSE printf('%.2f', value) END AS label
FROM (
  SELECT transport_status, count(*) AS n_patients,
         sum(n_ed) * 365.25::DOUBLE / sum(greatest(days_observed, 1)) AS m1,
         sum(n_inpatient) * 365.25::DOUBLE / sum(greatest(days_observed, 1)) AS m2,
         avg(CAST(n_ed > 0 AS INTEGER)) AS m3, avg(CAST(n_inpatient > 0 AS INTEGER)) AS m4
  FROM patient_analytic WHERE transport_status IN {STATUSES} GROUP BY transport_status
) g,
LATERAL (VALUES (1, 'ED visits / person-year', m1), (2, 'Inpatient admits / person-year', m2),
                (3, '% patients with any ED visit', m3), (4, '% patients admitted to hospital', m4))
        v(metric_order, metric, value)"""

FIG3 = f"""
SELECT setting_order, setting, {STATUS_ORDER} AS status_order, transport_status,
       {STATUS_LAB} AS status_lab, round(share, 6) AS share,
       CASE WHEN share > 0.02 THEN printf('%.0f%%', 100 * share) ELSE '' END AS label
FROM ({SETTING_MIX}) g,
LATERAL (VALUES (1, 'Emergency dept', share_ed), (2, 'Inpatient admit', share_inpatient),
                (3, 'Observation', share_obs), (4, 'Hospital OP dept', share_hod),
                (5, 'Outpatient face-to-face', share_opf2f),
                (6, 'Other / virtual / labs',
                 1 - (share_ed + share_inpatient + share_obs + share_hod + share_opf2f)))
        v(setting_order, setting, share)
WHERE transport_status IN {STATUSES}"""

FIG3_WIDE = f"""
SELECT setting_order, setting,
       max(share) FILTER (transport_status = 'no_barrier') AS no_barrier,
       max(share) FILTER (transport_status = 'barrier') AS barrier
FROM ({FIG3}) GROUP BY setting_order, setting"""

FIG4 = f"""
SELECT group_order, GroupCode, group_label, {STATUS_ORDER} AS status_order, transport_status,
       {COHORT} AS status_lab, n_patients,
       'n = ' || lpad(n_text, CAST(max(length(n_text)) OVER () AS INTEGER), ' ') AS n_label,
       round(pct_any_ed_180, 6) AS pct_any_ed_180,
       printf('%.0f%%', 100 * pct_any_ed_180) AS label,
       round(max(pct_any_ed_180) OVER () * 1.22::DOUBLE, 6) AS y_max
FROM (SELECT *, format('{{:,}}', n_patients) AS n_text FROM ({CHRONIC})
      WHERE transport_status IN {STATUSES})
JOIN (VALUES ('ECONOMY', 1, 'Economy'), ('LARGE', 2, 'Large'), ('MEDIUM', 3, 'Medium'),
             ('PROMO', 4, 'Promo')) g(code, group_order, group_label) ON code = GroupCode"""

FIG5 = f"""
WITH ages AS (
  SELECT transport_status, CAST(age_proxy AS DOUBLE) AS age FROM patient_analytic
  WHERE transport_status IN {STATUSES} AND age_proxy BETWEEN 0 AND 100
),
shape AS (
  SELECT transport_status, count(*) AS n, stddev_samp(age) AS sd,
         (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) / 1.34::DOUBLE AS iq, min(age) AS lowest
  FROM ages GROUP BY transport_status
),
width AS (
  SELECT transport_status, n,
         0.9::DOUBLE * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), nullif(abs(lowest), 0), 1)
           * pow(n, -0.2::DOUBLE) AS bw
  FROM shape
),
line AS (
  SELECT CAST(point AS INTEGER) AS point, lo + point * ((hi - lo) / 511) AS x
  FROM (SELECT min(age) AS lo, max(age) AS hi FROM ages), range(512) r(point)
)
SELECT transport_status, point, round(x, 6) AS x,
       round(sum(exp(-0.5::DOUBLE * pow((x - age) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6)
         AS density,
       round(any_value(bw), 6) AS bw
FROM ages JOIN width USING (transport_status) CROSS JOIN line
GROUP BY transport_status, point, x"""

COEFFICIENTS = """
SELECT term, round(est, 6) AS est, round(se, 6) AS se, round(z, 6) AS z, round(p, 6) AS p,
       round(odds_ratio, 6) AS odds_ratio, round(or_lo, 6) AS or_lo, round(or_hi, 6) AS or_hi, model
FROM coefficients"""

FIG2 = """
SELECT model, round(odds_ratio, 6) AS odds_ratio, round(or_lo, 6) AS or_lo, round(or_hi, 6) AS or_hi,
       CASE WHEN model = 'any_ED' THEN 'Any ED visit (≥1 in 5y)'
            ELSE 'Any inpatient admission (≥1 in 5y)' END AS outcome,
       printf('OR %.2f (%.2f–%.2f)', odds_ratio, or_lo, or_hi) AS label,
       round(or_hi + (max(or_hi) OVER () - 1) * 0.06::DOUBLE + 0.06::DOUBLE, 6) AS label_x,
       round((max(or_hi) OVER () + (max(or_hi) OVER () - 1) * 0.06::DOUBLE + 0.06::DOUBLE)
             * 1.08::DOUBLE, 6) AS x_max
FROM coefficients WHERE term = 'transportbarrier'"""


def rate_series(step: str, columns: str) -> str:
    """Person-time by brute force: every cohort member against every period of the calendar."""
    return f"""
WITH member AS (
  SELECT PatientDurableKey, {COHORT} AS cohort FROM patient_analytic
  WHERE transport_status IN {STATUSES}
),
period AS (
  SELECT CAST(s AS DATE) AS d0, CAST(s + INTERVAL {step} - INTERVAL 1 DAY AS DATE) AS d1
  FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-12-31', INTERVAL {step}) g(s)
),
seen AS (
  SELECT PatientDurableKey, CAST(min(encounter_ts) AS DATE) AS a, CAST(max(encounter_ts) AS DATE) AS z
  FROM encounters GROUP BY PatientDurableKey
),
exposure_time AS (
  SELECT cohort, d0,
         sum(greatest(0, date_diff('day', greatest(a, d0), least(z, d1)) + 1)) / 365.25::DOUBLE AS person_years
  FROM member JOIN seen USING (PatientDurableKey) CROSS JOIN period GROUP BY cohort, d0
),
visits AS (
  SELECT cohort, d0, count(*) AS n_ed, count(DISTINCT PatientDurableKey) AS n_any
  FROM member JOIN encounters USING (PatientDurableKey)
  JOIN period ON CAST(encounter_ts AS DATE) BETWEEN d0 AND d1
  WHERE IsEdVisit = 1 GROUP BY cohort, d0
),
size AS (SELECT cohort, count(*) AS n_patients FROM member GROUP BY cohort)
SELECT {columns} cohort, 'ed_per_person_year' AS metric,
       round(coalesce(n_ed, 0) / nullif(person_years, 0), 6) AS value,
       CAST(coalesce(n_ed, 0) AS BIGINT) AS n_ed, round(person_years, 6) AS person_years, n_patients,
       round(coalesce(n_any, 0) / n_patients::DOUBLE, 6) AS pct_any_ed
FROM size JOIN exposure_time USING (cohort) LEFT JOIN visits USING (cohort, d0)"""


BY_YEAR = rate_series("12 MONTHS", "CAST(year(d0) AS INTEGER) AS year,")
BY_QUARTER = rate_series(
    "3 MONTHS",
    "CAST(year(d0) AS INTEGER) AS year, CAST(quarter(d0) AS INTEGER) AS quarter, "
    "d0 AS period_start, year(d0) + (quarter(d0) - 1) / 4.0::DOUBLE AS t, "
    "strftime(d0, '%y') || ' Q' || quarter(d0) AS period_label,",
)


def axis(series: str, x: str, pad: str) -> str:
    """Limits from the unrounded series would differ in the last digits only."""
    return f"""
SELECT round(min({x})::DOUBLE - {pad}, 6) AS x_min, round(max({x})::DOUBLE + {pad}, 6) AS x_max,
       round(greatest(0, min(rate) * 0.95::DOUBLE), 6) AS y_min,
       round(max(rate) * 1.08::DOUBLE, 6) AS y_max
FROM (SELECT *, n_ed / nullif(py, 0) AS rate
      FROM (SELECT *, person_years AS py FROM ({series})))"""


def _unrounded(series: str) -> str:
    return series.replace("round(person_years, 6) AS person_years", "person_years")


SUMMARY = """
SELECT transport_status, count(*) AS n_patients, round(avg(age_proxy), 6) AS mean_age,
       quantile_cont(age_proxy, 0.5) AS median_age, round(avg(n_encounters), 6) AS mean_enc,
       quantile_cont(n_encounters, 0.5) AS median_enc, round(avg(n_ed), 6) AS mean_ed,
       quantile_cont(gap_median, 0.5) AS median_gap_days,
       round(avg(CAST(n_ed > 0 AS INTEGER)), 6) AS pct_any_ed,
       round(avg(CAST(n_inpatient > 0 AS INTEGER)), 6) AS pct_any_inpat
FROM patient_analytic GROUP BY transport_status"""

ROUNDED_MIX = """
SELECT transport_status, round(share_ed, 6) AS share_ed, round(share_inpatient, 6) AS share_inpatient,
       round(share_opf2f, 6) AS share_opf2f, round(share_hod, 6) AS share_hod,
       round(share_obs, 6) AS share_obs, total_encs, n_patients
FROM (""" + SETTING_MIX + ")"

ROUNDED_CHRONIC = """
SELECT * REPLACE (round(pct_any_ed_180, 6) AS pct_any_ed_180) FROM (""" + CHRONIC + ")"

ROW_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS tbl, count(*) AS n FROM {name}"
    for name in (
        "departments", "diagnosis", "encounters", "patients", "providers", "sdoh", "tiger",
    )
)

# name -> (views used, query)
QUERIES: dict[str, tuple[list[str], str]] = {
    "qa_row_counts": (
        ["departments", "diagnosis", "encounters", "patients", "providers", "sdoh", "tiger"],
        ROW_COUNTS,
    ),
    "qa_dup_encounter": (
        ["encounters"],
        "SELECT count(*) AS n_dup FROM (SELECT EncounterKey FROM encounters "
        "GROUP BY EncounterKey HAVING count(*) > 1)",
    ),
    "qa_diag_join": (
        ["encounters", "diagnosis"],
        left_join_audit(
            "encounters", "PrimaryDiagnosisKey", "diagnosis", "DiagnosisKey",
            "count(*) AS n_enc, count(*) FILTER (lk IS NULL) AS n_null_key, "
            "count(*) FILTER (lk IS NOT NULL AND rk IS NULL) AS n_unmatched_nonnull, "
            "count(rk) AS n_matched",
        ),
    ),
    "qa_patient_join": (
        ["encounters", "patients"],
        left_join_audit(
            "encounters", "PatientDurableKey", "patients", "PatientDurableKey",
            "count(*) AS n_enc, count(*) FILTER (rk IS NULL) AS n_unmatched",
        ),
    ),
    "qa_dept_join": (
        ["encounters", "departments"],
        left_join_audit(
            "encounters", "DepartmentKey", "departments", "DepartmentKey",
            "count(*) AS n_enc, count(*) FILTER (rk IS NULL) AS n_unmatched",
        ),
    ),
    "qa_sdoh_enc_join": (
        ["sdoh", "encounters"],
        left_join_audit(
            "sdoh", "EncounterKey", "encounters", "EncounterKey",
            "count(*) AS n_sdoh_rows, count(*) FILTER (rk IS NULL) AS n_unmatched_encounter",
        ),
    ),
    "qa_date_range": (
        ["encounters"],
        "SELECT min(encounter_ts) AS min_ts, max(encounter_ts) AS max_ts, "
        "count(*) FILTER (encounter_ts IS NULL) AS n_missing_ts, count(*) AS n FROM encounters",
    ),
    "qa_type_mix": (
        ["encounters"],
        "SELECT Type, count(*) AS n FROM encounters GROUP BY Type ORDER BY n DESC",
    ),
    "qa_bool_mix": (
        ["encounters"],
        "SELECT CAST(sum(IsEdVisit) AS BIGINT) AS n_ed, "
        "CAST(sum(IsHospitalAdmission) AS BIGINT) AS n_hosp_adm, "
        "CAST(sum(IsHospitalOutpatientVisit) AS BIGINT) AS n_hod, "
        "CAST(sum(IsInpatientAdmission) AS BIGINT) AS n_inpatient, "
        "CAST(sum(IsObservation) AS BIGINT) AS n_obs, "
        "CAST(sum(IsOutpatientFaceToFaceVisit) AS BIGINT) AS n_opf2f, "
        "count(*) AS n_total FROM encounters",
    ),
    "diagnosis_dedup": (["diagnosis_dedup"], whole("diagnosis_dedup")),
    "eda_top_diag_groups": (
        ["encounters", "diagnosis_dedup"], top_diagnoses("GroupCode", "GroupName", 40),
    ),
    "eda_top_diag_values": (
        ["encounters", "diagnosis_dedup"], top_diagnoses("DiagnosisValue", "DiagnosisName", 60),
    ),
    "eda_encounters_by_year": (
        ["encounters"],
        "SELECT year(encounter_ts) AS yr, count(*) AS n_enc, CAST(sum(IsEdVisit) AS BIGINT) AS n_ed, "
        "CAST(sum(IsHospitalAdmission) AS BIGINT) AS n_hospadm, "
        "CAST(sum(IsInpatientAdmission) AS BIGINT) AS n_inpat, "
        "CAST(sum(IsOutpatientFaceToFaceVisit) AS BIGINT) AS n_opf2f, "
        "CAST(sum(IsHospitalOutpatientVisit) AS BIGINT) AS n_hod FROM encounters GROUP BY ALL",
    ),
    "eda_encounters_by_depttype": (
        ["encounters", "departments"],
        "SELECT DepartmentType, count(*) AS n_enc, count(DISTINCT PatientDurableKey) AS n_patients, "
        "CAST(sum(IsEdVisit) AS BIGINT) AS n_ed "
        "FROM encounters LEFT JOIN departments USING (DepartmentKey) GROUP BY DepartmentType",
    ),
    "eda_sdoh_domain_coverage": (
        ["sdoh"],
        "SELECT coalesce(s.Domain, '(missing)') AS Domain, count(*) AS n_rows, "
        "count(DISTINCT PatientDurableKey) AS n_patients FROM sdoh s "
        "GROUP BY coalesce(s.Domain, '(missing)')",
    ),
    "eda_sdoh_patients_per_domain": (
        ["sdoh"],
        "SELECT Domain, count(PatientDurableKey) AS n_patients FROM "
        "(SELECT DISTINCT PatientDurableKey, Domain FROM sdoh WHERE Domain IS NOT NULL) GROUP BY Domain",
    ),
    "eda_fips_coverage": (
        ["patients"],
        "SELECT CASE WHEN FipsCode IS NULL OR FipsCode = '' OR FipsCode LIKE '*%' THEN 'unspecified' "
        "ELSE 'fips_present' END AS fips_state, count(*) AS n_patients FROM patients GROUP BY fips_state",
    ),
    "eda_fips_tiger_match": (
        ["patients", "tiger"],
        left_join_audit(
            "patients WHERE FipsCode IS NOT NULL AND FipsCode <> '' AND FipsCode NOT LIKE '*%'",
            "FipsCode", "tiger", "FipsCode",
            "count(*) AS n_patients_with_fips, count(*) FILTER (rk IS NULL) AS n_without_tiger",
        ),
    ),
    "eda_patients_by_birthyearbin": (
        ["patients"],
        "SELECT BirthYearBin, count(*) AS n_patients FROM patients GROUP BY BirthYearBin",
    ),
    "eda_enc_per_patient": (
        ["encounters"],
        "SELECT count(*) AS n_patients, min(n) AS min_enc, quantile_cont(n, 0.25) AS q25, "
        "quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75, "
        "round(quantile_cont(n, 0.95), 6) AS q95, max(n) AS max_enc, round(avg(n), 6) AS mean_enc "
        "FROM (SELECT PatientDurableKey, count(*) AS n FROM encounters GROUP BY PatientDurableKey)",
    ),
    "eda_sdoh_encounter_overlap": (
        ["sdoh", "encounters"],
        "WITH s AS (SELECT DISTINCT PatientDurableKey AS k FROM sdoh WHERE PatientDurableKey IS NOT NULL), "
        "e AS (SELECT DISTINCT PatientDurableKey AS k FROM encounters) "
        "SELECT (SELECT count(*) FROM s) AS n_patients_any_sdoh, "
        "(SELECT count(*) FROM e) AS n_patients_any_enc, "
        "(SELECT count(*) FROM s JOIN e USING (k)) AS n_overlap",
    ),
    "eda_transportation_answers": (
        ["sdoh"],
        "SELECT DisplayName, AnswerText, count(*) AS n FROM sdoh "
        "WHERE Domain = 'Transportation Needs' GROUP BY ALL "
        "ORDER BY n DESC, DisplayName, AnswerText LIMIT 30",
    ),
    "patient_transport": (["patient_transport"], whole("patient_transport")),
    "journey_transport_status_mix": (
        ["patient_transport"],
        "SELECT transport_status, count(*) AS n_patients, CAST(sum(transport_yes) AS BIGINT) AS n_ever_yes, "
        "CAST(sum(transport_no) AS BIGINT) AS n_ever_no FROM patient_transport GROUP BY transport_status",
    ),
    "patient_journey": (["patient_journey"], whole("patient_journey")),
    "patient_gaps": (["patient_gaps"], whole("patient_gaps")),
    "chronic_index": (["chronic_index"], whole("chronic_index")),
    "chronic_followup": (["chronic_followup"], whole("chronic_followup")),
    "journey_chronic_cohort_counts": (
        ["chronic_index"],
        "SELECT GroupCode, min(GroupName) AS GroupName, count(*) AS n_patients "
        "FROM chronic_index GROUP BY GroupCode",
    ),
    "patient_analytic": (["patient_analytic"], whole("patient_analytic")),
    "journey_patient_summary_by_transport": (["patient_analytic"], SUMMARY),
    "an_headline_by_transport": (["patient_analytic"], HEADLINE),
    "an_setting_mix_by_transport": (["patient_analytic"], ROUNDED_MIX),
    "an_chronic_followup_by_transport": (
        ["chronic_followup", "patient_analytic"], ROUNDED_CHRONIC,
    ),
    "an_annualized_rates_by_transport": (["patient_analytic"], RATES),
    "an_logit_or_transport": (["patient_analytic"], LOGIT_TABLE + COEFFICIENTS),
    "fig1_signature": (["patient_analytic"], SIGNATURE),
    "fig2_adjusted_or": (["patient_analytic"], LOGIT_TABLE + FIG2),
    "fig3_setting_mix_long": (["patient_analytic"], FIG3),
    "fig3_setting_mix_wide": (["patient_analytic"], FIG3_WIDE),
    "fig4_chronic_ed_180d": (["chronic_followup", "patient_analytic"], FIG4),
    "fig5_age_density": (["patient_analytic"], FIG5),
    "ed_by_year": (["patient_analytic"], BY_YEAR),
    "ed_by_quarter": (["patient_analytic"], BY_QUARTER),
    "ed_by_year_axis": (["patient_analytic"], axis(_unrounded(BY_YEAR), "year", "0.15::DOUBLE")),
    "ed_by_quarter_axis": (
        ["patient_analytic"],
        axis(_unrounded(BY_QUARTER), "t", "(max(t) - min(t)) * 0.02::DOUBLE"),
    ),
    **{f"csv_{name}": ([name], whole(name)) for name in SOURCES},
}

ORACLE = {name: with_views(views, body) for name, (views, body) in QUERIES.items()}
