"""Audits, profiles, reshaping, labels and density on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortrail.functions.columns import (
    days_between, fixed, percent, quantile, ranked, ratio, share, thousands,
)
from cohortrail.operators.audit import duplicate_keys, key_overlap, match_audit, table_counts
from cohortrail.operators.density import kernel_density
from cohortrail.operators.profile import dedup_by_key, top_groups
from cohortrail.operators.reshape import to_long, to_wide, with_residual


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_match_audit_counts_the_fan_out(spark):
    audit = match_audit(
        keys(spark, [1, 1, 2, 3, None]), "k", keys(spark, [1, 1, 1, 2, None]), "k"
    ).first()
    assert audit.n_rows == 2 * 3 + 1 + 1 + 1
    assert (audit.n_null_key, audit.n_unmatched_nonnull, audit.n_unmatched) == (1, 1, 2)
    assert audit.n_matched == 7


def test_match_audit_of_nothing(spark):
    audit = match_audit(keys(spark, []), "k", keys(spark, [1]), "k").first()
    assert audit.n_rows == 0


def test_duplicate_keys_include_null(spark):
    assert duplicate_keys(keys(spark, [1, 1, 1, 2, None, None]), "k").first().n_dup == 2


def test_key_overlap(spark):
    row = key_overlap(keys(spark, [1, 2, 2]), keys(spark, [2, 3, None]), "k").first()
    assert (row.n_left, row.n_right, row.n_both) == (2, 3, 1)


def test_table_counts_in_name_order(spark):
    rows = table_counts({"b": keys(spark, [1]), "a": keys(spark, [])}).collect()
    assert [(r.tbl, r.n) for r in rows] == [("a", 0), ("b", 1)]


def test_dedup_skips_nulls(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, "b", None), (2, None, None)], "k int, v string, w string"
    )
    assert {r.k: (r.v, r.w) for r in dedup_by_key(df, "k").collect()} == {
        1: ("b", "x"), 2: (None, None),
    }


def test_top_groups_break_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "g string")
    assert [r.g for r in top_groups(df, ["g"], "n", 2).collect()] == ["c", "a"]


def test_residual_may_be_negative(spark):
    df = spark.createDataFrame([("x", 0.7, 0.5)], "id string, a double, b double")
    long = to_long(with_residual(df, ["a", "b"], "rest"), ["id"], ["a", "b", "rest"], "k", "v")
    values = {r.k: r.v for r in long.collect()}
    assert values["rest"] == pytest.approx(-0.2)
    wide = to_wide(long, ["k"], "id", ["x", "absent"], "v").collect()
    assert {r.k: r.x for r in wide}["a"] == 0.7
    assert all(r.absent is None for r in wide)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_labels(spark):
    assert one(spark, percent(F.lit(0.125))) == "12%"
    assert one(spark, percent(F.lit(0.135))) == "14%"
    assert one(spark, fixed(F.lit(1.005), 2)) == "1.00"
    assert one(spark, fixed(F.lit(None).cast("double"), 2)) is None
    assert one(spark, thousands(F.lit(55653))) == "55,653"


def test_ratio_and_days(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, ratio(F.lit(101), F.lit(365.25))) == 101 / 365.25
    start, end = F.lit("2022-01-01 23:00").cast("timestamp_ntz"), F.lit("2022-01-02 01:00")
    assert one(spark, days_between(start, end.cast("timestamp_ntz"))) == 1


def test_share_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    assert df.agg(share(F.col("x") > 2).alias("v")).first().v == 0.5


def test_quantiles_exact_and_approximate(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert df.agg(quantile("x", 0.5).alias("v")).first().v == 2.5
    assert df.agg(quantile("x", 0.5, approx=True).alias("v")).first().v == 2.0


def test_ranked_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",)], "x string")
    assert [r.v for r in df.select(ranked(F.col("x"), ["a", "b"]).alias("v")).collect()] == [2, 1, None]


def density(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, age int")
    out = kernel_density(df, group="g", measure="age").collect()
    return {
        g: sorted((r.point, r.x, r.density, r.bw) for r in out if r.g == g) for g in groups
    }


def test_density_equals_the_kernel_sum(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.integers(20, 80, 300).tolist(), "b": rng.integers(1, 95, 80).tolist()}
    found = density(spark, groups)
    everyone = groups["a"] + groups["b"]
    grid = np.linspace(min(everyone), max(everyone), 512)
    for g, values in groups.items():
        v = np.array(values, dtype=float)
        iqr = np.quantile(v, 0.75) - np.quantile(v, 0.25)
        bw = 0.9 * min(v.std(ddof=1), iqr / 1.34) * len(v) ** -0.2
        expected = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(axis=1)
        expected /= len(v) * bw * np.sqrt(2 * np.pi)
        assert [x for _, x, _, _ in found[g]] == pytest.approx(grid.tolist())
        assert [d for _, _, d, _ in found[g]] == pytest.approx(expected.tolist())
        assert found[g][0][3] == pytest.approx(bw)


def test_density_has_area_one_inside_a_wide_range(spark):
    found = density(spark, {"a": [0, 100, 48, 50, 52, 49, 51] * 30, "b": [50, 51, 49, 50, 48, 52]})
    points = found["b"]
    assert np.trapezoid([p[2] for p in points], [p[1] for p in points]) == pytest.approx(1, abs=0.01)


def test_density_bandwidth_fallbacks(spark):
    """No interquartile range: the standard deviation; no spread at all: the value itself."""
    found = density(spark, {"a": [10] * 20 + [30], "b": [5, 5, 5]})
    sd = np.std([10] * 20 + [30], ddof=1)
    assert found["a"][0][3] == pytest.approx(0.9 * sd * 21**-0.2)
    assert found["b"][0][3] == pytest.approx(0.9 * 5 * 3**-0.2)


def test_binned_density_of_a_continuous_measure(spark):
    """Near the exact kernel sum, by rows as many as the grid has points and not as there are values."""
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(50, 9, 4000)] + [("b", float(v)) for v in rng.gamma(4, 6, 3000)]
    df = spark.createDataFrame(rows, "g string, age double")
    exact = {(r.g, r.point): r for r in kernel_density(df, group="g", measure="age").collect()}
    binned = kernel_density(df, group="g", measure="age", binned=True)
    found = {(r.g, r.point): r for r in binned.collect()}
    assert found.keys() == exact.keys()
    step = (max(v for _, v in rows) - min(v for _, v in rows)) / 511
    for g in "ab":
        top = max(r.density for (k, _), r in exact.items() if k == g)
        for point in range(512):
            one, other = exact[g, point], found[g, point]
            assert other.x == pytest.approx(one.x)
            assert other.bw == pytest.approx(one.bw, rel=1e-3)
            assert abs(other.density - one.density) <= top * ((step / one.bw) ** 2 / 8 + 2e-3)
    # Only grid points reach the kernel's expansion.
    text = binned._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Generate explode(") :]
    assert "HashAggregate(keys=[g" in below[: below.index("Generate inline(")]
    empty = kernel_density(df.limit(0), group="g", measure="age", binned=True)
    assert empty.collect() == []
    same = kernel_density(spark.createDataFrame([("a", 5.0)] * 3, "g string, age double"),
                          group="g", measure="age", binned=True).collect()
    assert len(same) == 512
