"""Reports merged from stored sketches, against exact ones."""

import numpy as np
import pytest

from cohortrail.plans import compare, eda, sketches
from cohortrail.sources.sample import SAMPLE_STUDY, source_tables
from cohortrail.workspace import Workspace
from dataclasses import replace

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A workspace that asks for approximate reports, with its sketches stored, and the patients."""
    folder = tmp_path_factory.mktemp("sketches")
    exact = Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY)
    exact["patient_analytic"].write.parquet(str(folder / "analytic"))
    exact.put("patient_analytic", spark.read.parquet(str(folder / "analytic")))
    sketches.patient_sketches(exact).write.parquet(str(folder / "sketches"))
    approx = Workspace(source_tables(spark, SF_DIR), replace(SAMPLE_STUDY, approx=True))
    approx.put("patient_sketches", spark.read.parquet(str(folder / "sketches")))
    return exact, approx


QUANTILES = {
    "median_age": ("age_proxy", 0.5), "median_enc": ("n_encounters", 0.5), "median_ed": ("n_ed", 0.5),
    "median_gap_days": ("gap_median", 0.5), "median_gap_q75": ("gap_q75", 0.5),
}


def rank_error(values, value, q):
    """How far the rank of a value is from the one asked for; equal values share a range of ranks."""
    values = np.sort(values)
    low, high = np.searchsorted(values, [value, value], side="left")[0], np.searchsorted(values, value, side="right")
    return max(0.0, low / len(values) - q, q - high / len(values))


@pytest.mark.parametrize("report", [compare.patient_summary_by_transport, compare.headline_by_transport])
def test_reports_equal_exact_ones_but_for_quantiles_in_bounds(stored, report):
    exact, approx = stored
    one, other = report(exact), report(approx)
    assert other.dtypes == one.dtypes
    want, got = one.collect(), other.collect()
    assert [r.transport_status for r in got] == [r.transport_status for r in want]
    patients = exact["patient_analytic"].select(
        "transport_status", *{m for m, _ in QUANTILES.values()}
    ).toPandas()
    for a, b in zip(want, got):
        mine = patients[patients.transport_status.isna() if a.transport_status is None
                        else patients.transport_status == a.transport_status]
        for name in one.columns:
            if name in QUANTILES:
                measure, q = QUANTILES[name]
                assert rank_error(mine[measure].dropna(), b[name], q) <= sketches.RANK_ERROR, name
            else:
                assert b[name] == pytest.approx(a[name]), name


def test_distribution_over_patients(stored):
    exact, approx = stored
    want, got = eda.enc_per_patient(exact).first(), eda.enc_per_patient(approx).first()
    for name in ("n_patients", "min_enc", "max_enc", "mean_enc"):
        assert got[name] == pytest.approx(want[name])
    counts = [r.n for r in exact["encounters"].groupBy("PatientDurableKey").count().toDF("p", "n").collect()]
    for name, q in {"q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}.items():
        assert rank_error(counts, got[name], q) <= sketches.RANK_ERROR


def test_distinct_patients_are_merged_without_counting_twice(stored):
    exact, approx = stored
    analytic = exact["patient_analytic"]
    want = analytic.select("PatientDurableKey").distinct().where("PatientDurableKey is not null").count()
    got = sketches.distinct_patients(approx).first().n_patients
    assert abs(got - want) <= 0.03 * want


def test_merging_reads_no_patients(stored):
    _, approx = stored
    plan = compare.headline_by_transport(approx)._jdf.queryExecution().executedPlan().toString()
    assert "sketches" in plan and "lineitem" not in plan and "analytic" not in plan


def test_group_without_a_value_has_no_quantile(spark):
    rows = [(1, "barrier", None, 3, 0, 0, 0, None, None, None, 5), (2, None, None, 1, 1, 0, 0, 44, None, None, None)]
    schema = (
        "PatientDurableKey long, transport_status string, first_ts timestamp_ntz, n_encounters long, n_ed long, "
        "n_inpatient long, n_obs long, age_proxy int, gap_median double, gap_q75 double, block_population int"
    )
    ws = Workspace.of({"patient_analytic": spark.createDataFrame(rows, schema)}, replace(SAMPLE_STUDY, approx=True))
    ws.put("patient_sketches", sketches.patient_sketches(ws))
    found = {r.transport_status: r for r in compare.patient_summary_by_transport(ws).collect()}
    assert found["barrier"].median_age is None and found["barrier"].mean_age is None
    assert found["barrier"].median_enc == 3.0
    assert found[None].median_age == 44.0
