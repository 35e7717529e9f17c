"""Chart data: the numbers, labels and display order behind each figure.

Each function takes the result tables it needs, either fresh or read back from their CSV files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.functions.columns import fixed, lookup, percent, ranked, thousands
from cohortrail.operators.density import kernel_density
from cohortrail.operators.reshape import to_long, to_wide, with_residual
from cohortrail.plans import compare
from cohortrail.plans.tables import screened_patients
from cohortrail.study import Study
from cohortrail.workspace import Workspace

# Panel titles of the signature chart, in display order.
PANELS = (
    ("ed_per_person_year", "ED visits / person-year"),
    ("inpat_per_person_year", "Inpatient admits / person-year"),
    ("pct_any_ed", "% patients with any ED visit"),
    ("pct_any_inpat", "% patients admitted to hospital"),
)

# Care settings in stacking order.
SETTINGS = (
    ("share_ed", "Emergency dept"),
    ("share_inpatient", "Inpatient admit"),
    ("share_obs", "Observation"),
    ("share_hod", "Hospital OP dept"),
    ("share_opf2f", "Outpatient face-to-face"),
    ("share_other", "Other / virtual / labs"),
)

# Outcome names of the odds-ratio chart.
OUTCOMES = (
    ("any_ED", "Any ED visit (≥1 in {years}y)"),
    ("any_inpatient", "Any inpatient admission (≥1 in {years}y)"),
)


def over_all(column: Column) -> Column:
    """A value over all rows; only for results of a few rows, which one small task holds."""
    return column.over(Window.partitionBy())


def compared_only(df: DataFrame, study: Study) -> DataFrame:
    return df.where(F.col("transport_status").isin(*study.compared_statuses))


def status_label(study: Study, n_patients: Column) -> Column:
    """Cohort name over its size, as the axis text of the bar charts."""
    name = lookup(F.col("transport_status"), study.compared)
    return F.concat(name, F.lit("\n(n = "), thousands(n_patients), F.lit(")"))


def status_order(study: Study) -> Column:
    return ranked(F.col("transport_status"), study.compared_statuses)


def padded_count(n: Column) -> Column:
    """'n = 1,234', padded on the left to the widest count of the table."""
    text = thousands(n)
    width = over_all(F.max(F.length(text)))
    return F.concat(F.lit("n = "), F.lpad(text, width, F.lit(" ")))


def signature(summary: DataFrame, study: Study) -> DataFrame:
    """Two rates and two shares per compared group, in long form."""
    titles = [title for _, title in PANELS]
    named = compared_only(summary, study).select(
        "transport_status", "n_patients", *[F.col(c).alias(title) for c, title in PANELS]
    )
    metric, value = F.col("metric"), F.col("value")
    return (
        to_long(named, ["transport_status", "n_patients"], titles, "metric", "value")
        .select(
            ranked(metric, titles).alias("metric_order"),
            "metric",
            status_order(study).alias("status_order"),
            "transport_status",
            status_label(study, F.col("n_patients")).alias("status_lab"),
            "value",
            F.when(metric.startswith("%"), percent(value))
            .otherwise(fixed(value, 2))
            .alias("label"),
        )
        .orderBy("metric_order", "status_order")
    )


def signature_summary(ws: Workspace) -> DataFrame:
    """The four measures of the signature chart from one pass over the patients."""
    return (
        compared_only(screened_patients(ws), ws.study)
        .groupBy("transport_status")
        .agg(
            F.count(F.lit(1)).alias("n_patients"),
            *compare.annual_rates(),
            *compare.any_visit_shares(),
        )
    )


def adjusted_or(coefficients: DataFrame, study: Study) -> DataFrame:
    """The exposure term of each model with its interval, label, label position and x limit."""
    exposure = "transport" + study.compared_statuses[1]
    ratio_, lo, hi = F.col("odds_ratio"), F.col("or_lo"), F.col("or_hi")
    label = F.concat(
        F.lit("OR "), fixed(ratio_, 2), F.lit(" ("), fixed(lo, 2), F.lit("–"), fixed(hi, 2),
        F.lit(")"),
    )
    model = F.col("model")
    titles = [title.format(years=study.years) for _, title in OUTCOMES]
    outcome = F.when(model == OUTCOMES[0][0], titles[0]).otherwise(titles[1])
    return (
        coefficients.where(F.col("term") == exposure)
        .select(
            "model",
            "odds_ratio",
            "or_lo",
            "or_hi",
            outcome.alias("outcome"),
            label.alias("label"),
            (hi + (over_all(F.max(hi)) - 1) * 0.06 + 0.06).alias("label_x"),
        )
        .withColumn("x_max", over_all(F.max("label_x")) * 1.08)
        .orderBy("odds_ratio")
    )


def setting_mix_long(set_mix: DataFrame, study: Study) -> DataFrame:
    """Share of encounters by setting and group, the residual category included."""
    names = [name for name, _ in SETTINGS]
    complete = with_residual(compared_only(set_mix, study), names[:-1], names[-1])
    long = to_long(complete, ["transport_status", "n_patients"], names, "part", "share")
    part, portion = F.col("part"), F.col("share")
    return long.select(
        ranked(part, names).alias("setting_order"),
        lookup(part, SETTINGS).alias("setting"),
        status_order(study).alias("status_order"),
        "transport_status",
        status_label(study, F.col("n_patients")).alias("status_lab"),
        "share",
        F.when(portion > 0.02, percent(portion)).otherwise("").alias("label"),
    ).orderBy("setting_order", "status_order")


def setting_mix_wide(set_mix: DataFrame, study: Study) -> DataFrame:
    """One row per setting, one column per compared group."""
    return to_wide(
        setting_mix_long(set_mix, study),
        rows=["setting_order", "setting"],
        columns="transport_status",
        levels=study.compared_statuses,
        value="share",
    ).orderBy("setting_order")


def chronic_ed(chronic: DataFrame, study: Study) -> DataFrame:
    """Share with an ED visit within 180 days of index, by condition and group."""
    portion = F.col("pct_any_ed_180")
    return (
        compared_only(chronic, study)
        .select(
            ranked(F.col("GroupCode"), study.group_codes).alias("group_order"),
            "GroupCode",
            lookup(F.col("GroupCode"), study.index_groups).alias("group_label"),
            status_order(study).alias("status_order"),
            "transport_status",
            lookup(F.col("transport_status"), study.compared).alias("status_lab"),
            "n_patients",
            padded_count(F.col("n_patients")).alias("n_label"),
            "pct_any_ed_180",
            percent(portion).alias("label"),
            (over_all(F.max(portion)) * 1.22).alias("y_max"),
        )
        .orderBy("group_order", "status_order")
    )


def age_density(ws: Workspace) -> DataFrame:
    """Density of age per compared group on a common grid of 512 points."""
    youngest, oldest = ws.study.age_range
    ages = compared_only(screened_patients(ws), ws.study).where(
        F.col("age_proxy").between(youngest, oldest)
    )
    return kernel_density(ages, group="transport_status", measure="age_proxy")


FIGURES = {
    "fig1_signature": lambda ws: signature(signature_summary(ws), ws.study),
    "fig2_adjusted_or": lambda ws: adjusted_or(compare.logit_or_transport(ws), ws.study),
    "fig3_setting_mix_long": lambda ws: setting_mix_long(
        compare.setting_mix_by_transport(ws), ws.study
    ),
    "fig3_setting_mix_wide": lambda ws: setting_mix_wide(
        compare.setting_mix_by_transport(ws), ws.study
    ),
    "fig4_chronic_ed_180d": lambda ws: chronic_ed(
        compare.chronic_followup_by_transport(ws), ws.study
    ),
    "fig5_age_density": age_density,
}
