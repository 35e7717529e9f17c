"""Mergeable sketches of the patient table, for reports that need not be exact.

One stored row per exposure status and year of the first encounter holds additive counts and sums,
quantile sketches (KLL) of the measures and a sketch of the distinct patients (HyperLogLog). Reports
by status, and over all patients, merge these few rows and do not read patients again; rows of
another year can be added without touching the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.functions.columns import ratio
from cohortrail.plans.tables import PATIENT
from cohortrail.workspace import Workspace

#: Size of a quantile sketch: ranks are off by half a percent at most, with a confidence of 99 %.
KLL_K = 800
RANK_ERROR = 0.005
#: Logarithm of the registers of a distinct count, whose standard error is then below one percent.
HLL_LG_K = 14

# Measures with a quantile sketch, and the kind of sketch.
MEASURES = {
    "n_encounters": "bigint",
    "n_ed": "bigint",
    "age_proxy": "bigint",
    "gap_median": "double",
    "gap_q75": "double",
}
MEANS = ("n_encounters", "n_ed", "age_proxy")
ANY = {"any_ed": "n_ed", "any_inpat": "n_inpatient", "any_obs": "n_obs"}


def patient_sketches(ws: Workspace) -> DataFrame:
    """Rows per (transport_status, entry_year, listed_once).

    A patient that several listings or blocks match counts in the comparisons once for each, and
    once in the distribution over patients: ``listed_once`` keeps first rows and further ones apart.
    """
    first = Window.partitionBy(PATIENT).orderBy("block_population")
    rows = ws["patient_analytic"].withColumn("listed_once", F.row_number().over(first) == 1)
    kll = {m: getattr(F, f"kll_sketch_agg_{kind}") for m, kind in MEASURES.items()}
    return rows.groupBy(
        "transport_status", F.year("first_ts").alias("entry_year"), "listed_once"
    ).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.min("n_encounters").alias("min_enc"),
        F.max("n_encounters").alias("max_enc"),
        F.hll_sketch_agg(PATIENT, HLL_LG_K).alias("patients"),
        *[F.count_if(F.col(c) > 0).alias(name) for name, c in ANY.items()],
        *[F.count(m).alias(f"count_{m}") for m in MEANS],
        *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(f"sum_{m}") for m in MEANS],
        *[kll[m](F.col(m).cast(kind), KLL_K).alias(f"kll_{m}") for m, kind in MEASURES.items()],
    )


def _merged(rows: DataFrame, *by: str) -> DataFrame:
    summed = ["n_patients", *ANY, *(f"{x}_{m}" for x in ("count", "sum") for m in MEANS)]
    merge = {m: getattr(F, f"kll_merge_agg_{kind}") for m, kind in MEASURES.items()}
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in summed],
        F.min("min_enc").alias("min_enc"),
        F.max("max_enc").alias("max_enc"),
        F.hll_union_agg("patients").alias("patients"),
        *[merge[m](f"kll_{m}").alias(f"kll_{m}") for m in MEASURES],
    )


def _quantile(measure: str, q: float) -> Column:
    """NULL where a group has no value: an empty sketch has no quantiles."""
    kind, sketch = MEASURES[measure], F.col(f"kll_{measure}")
    some = getattr(F, f"kll_sketch_get_n_{kind}")(sketch) > 0
    value = getattr(F, f"kll_sketch_get_quantile_{kind}")(sketch, F.lit(q))
    return F.when(some, value.cast("double"))


def _mean(measure: str) -> Column:
    return ratio(F.col(f"sum_{measure}"), F.col(f"count_{measure}"))


def _share(name: str) -> Column:
    return ratio(F.col(name), F.col("n_patients"))


def patient_summary(ws: Workspace) -> DataFrame:
    merged = _merged(ws["patient_sketches"], "transport_status")
    return merged.select(
        "transport_status",
        "n_patients",
        _mean("age_proxy").alias("mean_age"),
        _quantile("age_proxy", 0.5).alias("median_age"),
        _mean("n_encounters").alias("mean_enc"),
        _quantile("n_encounters", 0.5).alias("median_enc"),
        _mean("n_ed").alias("mean_ed"),
        _quantile("gap_median", 0.5).alias("median_gap_days"),
        _share("any_ed").alias("pct_any_ed"),
        _share("any_inpat").alias("pct_any_inpat"),
    ).orderBy(F.col("n_patients").desc(), "transport_status")


def headline(ws: Workspace) -> DataFrame:
    """One row per status of screened patients, in no order."""
    screened = ws["patient_sketches"].where(F.col("transport_status").isNotNull())
    return _merged(screened, "transport_status").select(
        "transport_status",
        "n_patients",
        _mean("n_encounters").alias("mean_enc"),
        _quantile("n_encounters", 0.5).alias("median_enc"),
        _mean("n_ed").alias("mean_ed"),
        _quantile("n_ed", 0.5).alias("median_ed"),
        _share("any_ed").alias("pct_any_ed"),
        _share("any_inpat").alias("pct_any_inpat"),
        _share("any_obs").alias("pct_any_obs"),
        _mean("age_proxy").alias("mean_age"),
        _quantile("gap_median", 0.5).alias("median_gap_days"),
        _quantile("gap_q75", 0.5).alias("median_gap_q75"),
    )


def encounters_per_patient(ws: Workspace) -> DataFrame:
    once = _merged(ws["patient_sketches"].where("listed_once"))
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    return once.select(
        "n_patients",
        "min_enc",
        *[_quantile("n_encounters", q).alias(name) for name, q in names.items()],
        "max_enc",
        _mean("n_encounters").alias("mean_enc"),
    )


def distinct_patients(ws: Workspace, *by: str) -> DataFrame:
    """About how many patients each group has, however many rows they have in it."""
    merged = ws["patient_sketches"].groupBy(*by).agg(F.hll_union_agg("patients").alias("patients"))
    return merged.select(*by, F.hll_sketch_estimate("patients").alias("n_patients"))
