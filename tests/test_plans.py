"""What the physical plans must and must not contain."""

import os
import re

import pytest

import __spark_entry__ as driver
from cohortrail import session
from cohortrail.plans.catalog import CATALOG
from cohortrail.sources.sample import SAMPLE_STUDY, SCHEMAS, source_tables
from cohortrail.workspace import Workspace
from tests.compare import assert_same, duck
from tests.conftest import SF_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def direct(spark, name):
    return CATALOG[name](Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY))


# The two model queries run their jobs while being built and end in a local table.
LAZY = [n for n in driver.NUMBERED.values() if n not in ("an_logit_or_transport", "fig2_adjusted_or")]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(direct(spark, name))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text
    assert "Pandas" not in text


def test_rates_read_no_gaps_and_no_distinct_counts(spark):
    text = plan(direct(spark, "an_annualized_rates_by_transport"))
    assert "Window" not in text
    assert "Expand" not in text


@pytest.mark.parametrize("name", ["patient_journey", "patient_gaps", "patient_analytic", "ed_by_year"])
def test_events_are_aggregated_by_hash(spark, name):
    assert "SortAggregate" not in plan(direct(spark, name))


def nodes(plan_node):
    """All nodes of the plan that ran, in and below adaptive stages."""
    kind = plan_node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan_node.executedPlan())
        return
    yield plan_node
    if kind.endswith("QueryStageExec"):
        yield from nodes(plan_node.plan())
        return
    children = plan_node.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def ran(df) -> list:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return list(nodes(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize(
    "name", ["patient_days", "patient_journey", "patient_gaps", "patient_analytic", "chronic_followup", "ed_by_quarter"]
)
def test_no_entity_is_gathered_in_one_value(spark, name):
    """Per-patient tables hold no object aggregate, whose maps fall back to sorting past a limit."""
    assert "ObjectHashAggregate" not in plan(direct(spark, name))


@pytest.mark.parametrize(
    "name", ["journey_patient_summary_by_transport", "an_headline_by_transport", "eda_enc_per_patient", "fig5_age_density"]
)
def test_no_aggregate_falls_back_to_sorting(spark, name):
    """Quantiles of groups stay within the default number of keys of an object aggregate."""
    found = [n.metrics().get("numTasksFallBacked") for n in ran(direct(spark, name))]
    metrics = [m.get() for m in found if m.isDefined()]
    assert metrics and all(m.value() == 0 for m in metrics)


def exchanges_of(df, column: str) -> list[str]:
    return [
        line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line and column in line
    ]


@pytest.mark.parametrize("name", ["patient_journey", "patient_analytic", "an_headline_by_transport", "ed_by_year"])
def test_encounters_are_read_once(spark, name):
    scans = re.findall(r"Scan parquet .*l_shipdate", plan(direct(spark, name)))
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["an_setting_mix_by_transport", "an_headline_by_transport", "ed_by_year"])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_screened_patients_alone_are_added_up_if_their_table_is_small(spark, conf, name, threshold):
    """The semi-join on exposure stands below the events' aggregation where it can be broadcast, and
    otherwise on its rows: sums of patients, or their days, which are added up further above."""
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    df = direct(spark, name)
    logical = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    semi = next(k for k, line in enumerate(logical) if "LeftSemi" in line)
    above = [k for k in range(semi) if depth(logical[k]) < depth(logical[semi])]
    added_up = any("Aggregate [PatientDurableKey" in logical[k] for k in above)
    assert added_up == (threshold != "-1" or name == "an_headline_by_transport")


INITIAL_PARTITIONS = session.INITIAL_PARTITIONS.replace(".", "__")


def dealt_to(df) -> set[int]:
    """Numbers of partitions of the exchanges by patient."""
    found = [re.search(r"hashpartitioning\(.*, (\d+)\)", line) for line in exchanges_of(df, "PatientDurableKey")]
    return {int(m.group(1)) for m in found}


@pytest.mark.parametrize("name", ["q26_patient_gaps", "q31_journey_patient_summary_by_transport"])
def test_exchanges_grow_with_the_input(spark, conf, monkeypatch, name):
    """A task's share of the tables does not grow with them, whatever number the session has."""
    conf(**{INITIAL_PARTITIONS: "8"})
    query = driver.queries()[name]
    assert dealt_to(query(spark, SF_DIR)) == {8}
    size = sum(os.path.getsize(f"{SF_DIR}/{table}.parquet") for table in SCHEMAS)
    monkeypatch.setattr(session, "PARTITION_BYTES", size // 40)
    assert min(dealt_to(query(spark, SF_DIR))) >= 40
    # A smaller input afterwards: the number is not kept.
    monkeypatch.undo()
    assert dealt_to(query(spark, SF_DIR)) == {8}


def test_scan_reads_only_what_the_audit_needs(spark):
    text = plan(direct(spark, "qa_dept_join"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(s == "l_orderkey:bigint,l_suppkey:bigint" for s in schemas)


def test_date_range_and_flag_reach_a_stored_table(spark, conf, tmp_path):
    """On the stored encounters the event filter of the rate series is pushed to the scan."""
    conf(spark__sql__maxMetadataStringLength="2000")
    ws = Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY)
    for name in ("encounters", "patient_analytic"):
        path = str(tmp_path / name)
        ws[name].write.parquet(path)
        ws.put(name, spark.read.parquet(path))
    text = plan(CATALOG["ed_by_year"](ws))
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    assert any("EqualTo(IsEdVisit,1)" in p and "encounter_ts" in p for p in pushed)
    assert "Window" not in text


def test_index_table_is_computed_once_for_follow_up(spark):
    df = direct(spark, "chronic_followup")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_top_diagnoses_shuffle_encounters_once(spark):
    df = direct(spark, "eda_top_diag_groups")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_hot_patient_follow_up_has_no_straggler(spark, conf, tmp_path):
    """One patient with most events and adaptive splitting off: only its days go to one task, not its
    events, and the result is DuckDB's."""
    from pyspark.sql import functions as F

    ws = Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY)
    hot = ws["encounters"].withColumn(
        "PatientDurableKey",
        F.when(F.col("Type") < "4", F.lit(7).cast("long")).otherwise(F.col("PatientDurableKey")),
    )
    path = str(tmp_path / "hot")
    hot.repartition(16).write.parquet(path)
    again = Workspace(source_tables(spark, SF_DIR), SAMPLE_STUDY)
    again.put("encounters", spark.read.parquet(path))
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__enabled="false",
    )
    df = again["chronic_followup"]
    lines = plan(df).splitlines()
    below = [
        following
        for line, following in zip(lines, lines[1:])
        if "Exchange hashpartitioning" in line and "e_entity" in line and "e_day" not in line
    ]
    # What is exchanged by patient alone is aggregated days, never events.
    assert below and all("HashAggregate" in line for line in below), lines
    con = duck(SF_DIR)
    oracle = driver.oracle_sql()["q28_chronic_followup"]
    head, sources = "WITH encounters AS (", oracle.index("),\ndiagnosis AS (")
    assert oracle.startswith(head)
    replaced = f"{head}SELECT * FROM read_parquet('{path}/*.parquet')" + oracle[sources:]
    assert_same(df, con.execute(replaced))


@pytest.mark.parametrize(
    "name", ["q03_qa_diag_join", "q25_patient_journey", "q28_chronic_followup", "q42_ed_by_year"]
)
def test_results_hold_without_any_broadcast(spark, conf, name):
    """The way taken when no side is small enough to broadcast gives the same rows."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    df = driver.queries()[name](spark, SF_DIR)
    assert "BroadcastHashJoin" not in plan(df)
    assert_same(df, duck(SF_DIR).execute(driver.oracle_sql()[name]))
