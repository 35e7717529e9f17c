"""Every registered query against DuckDB on the same files."""

import pytest

import __spark_entry__ as driver
from tests.compare import assert_same, duck
from tests.conftest import SF_DIR

# The training-data queries have tests of their own, as that part may be absent.
QUERIES = {k: v for k, v in driver.queries().items() if k not in driver.LLM_QUERIES}
ORACLE = {k: v for k, v in driver.oracle_sql().items() if k not in driver.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len({name[:3] for name in QUERIES if name.startswith("q")}) == 43


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert_same(df, con.execute(ORACLE[name]))


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.count() > 0
    assert "ed_per_person_year" in df.columns


def test_sample_meets_every_branch(spark):
    """The sample tables hold the awkward values the queries must get right."""
    from cohortrail.sources.sample import SAMPLE_STUDY, source_tables
    from cohortrail.workspace import Workspace

    ws = Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY)
    enc = ws["encounters"]
    for column in ("PatientDurableKey", "PrimaryDiagnosisKey", "encounter_ts"):
        assert enc.where(f"{column} IS NULL").count() > 0
    assert enc.where("hour(encounter_ts) > 0").count() > 0
    statuses = {r[0] for r in ws["patient_transport"].select("transport_status").collect()}
    assert statuses == {"barrier", "no_barrier", "declined", "other"}
    # The top-k reports leave groups out, the calendar leaves flagged events out.
    known = ws["diagnosis_dedup"].where("DiagnosisKey >= 0")
    assert known.select("GroupCode").distinct().count() > 41
    assert known.select("DiagnosisValue").distinct().count() > 61
    asked = ws["sdoh"].where("Domain = 'Transportation Needs'")
    assert asked.select("DisplayName", "AnswerText").distinct().count() > 30
    outside = "IsEdVisit = 1 AND year(encounter_ts) NOT BETWEEN 1996 AND 2000"
    assert enc.where(outside).count() > 0
    analytic = ws["patient_analytic"]
    assert analytic.count() > analytic.select("PatientDurableKey").distinct().count()
