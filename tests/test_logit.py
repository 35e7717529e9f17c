"""Odds-ratio table: shape, ordering, precision, and equality with a row-level fit in numpy."""

import math

import numpy as np
import pytest

from cohortrail.operators.logit import COEFFICIENT_SCHEMA, Factor, coefficient_row, odds_ratios


def logistic(x):
    return 1 / (1 + np.exp(-x))


def irls(design, y):
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        mu = logistic(design @ beta)
        information = design.T @ (design * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(information, design.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(information)))


def fit(spark, columns, schema, label, covariates, factors=()):
    rows = list(zip(*[[v.item() if hasattr(v, "item") else v for v in c] for c in columns]))
    frame = spark.createDataFrame(rows, schema)
    return {
        r.term: r for r in odds_ratios(frame, {"y": label}, covariates, list(factors)).collect()
    }


def shares(*cells):
    """x, y columns from (x, ones, zeros) triples."""
    rows = [(x, y) for x, ones, zeros in cells for y, n in ((1, ones), (0, zeros)) for _ in range(n)]
    return [np.array(c) for c in zip(*rows)]


def test_two_by_two_table_has_its_closed_form(spark):
    """One binary covariate: the odds ratio is ad/bc, its variance the sum of reciprocals."""
    table = fit(spark, shares((1, 30, 20), (0, 15, 45)), "x int, y int", "label", ["x"])
    assert list(table) == ["(Intercept)", "x"]
    assert ", ".join(f.split()[0] for f in COEFFICIENT_SCHEMA.split(", ")) == ", ".join(
        table["x"].asDict()
    )
    row = table["x"]
    assert row.model == "label"
    assert row.odds_ratio == pytest.approx(30 * 45 / (20 * 15), rel=1e-7)
    error = math.sqrt(1 / 30 + 1 / 20 + 1 / 15 + 1 / 45)
    assert row.se == pytest.approx(error, rel=1e-7)
    assert math.log(row.or_hi / row.or_lo) == pytest.approx(2 * 1.96 * error, rel=1e-7)


def test_repeating_all_rows_only_shrinks_errors(spark):
    cells = ((1, 9, 6), (0, 7, 11))
    once = fit(spark, shares(*cells), "x int, y int", "t", ["x"])["x"]
    many = fit(spark, shares(*[(x, 4 * a, 4 * b) for x, a, b in cells]), "x int, y int", "t", ["x"])
    assert many["x"].est == pytest.approx(once.est, abs=1e-7)
    assert many["x"].se == pytest.approx(once.se / 2, rel=1e-6)


def test_swapping_the_baseline_turns_the_sign(spark):
    x, y = shares((1, 12, 5), (0, 8, 21))
    plain = fit(spark, (x, y), "x int, y int", "t", ["x"])["x"]
    turned = fit(spark, (1 - x, y), "x int, y int", "t", ["x"])["x"]
    assert turned.est == pytest.approx(-plain.est, abs=1e-7)
    assert (turned.or_lo, turned.or_hi) == pytest.approx((1 / plain.or_hi, 1 / plain.or_lo))


def test_several_terms_equal_a_row_level_fit(spark):
    rng = np.random.default_rng(2026)
    a, b = rng.integers(0, 2, 250), rng.integers(-3, 4, 250).astype(float)
    y = (rng.random(250) < logistic(0.3 * b - a)).astype(int)
    table = fit(spark, (a, b, y), "a int, b double, y int", "t", ["a", "b"])
    beta, se = irls(np.column_stack([np.ones(250), a, b]), y)
    assert [r.est for r in table.values()] == pytest.approx(beta, abs=1e-7)
    assert [r.se for r in table.values()] == pytest.approx(se, abs=1e-7)
    assert table["b"].p == pytest.approx(math.erfc(abs(beta[2] / se[2]) / math.sqrt(2)), abs=1e-8)


def test_awkward_models_still_give_a_table(spark):
    x, y = shares((1, 12, 5), (0, 8, 21))
    alone = fit(spark, (x, y), "x int, y int", "t", ["x"])
    twice = fit(spark, (x, 2.0 * x - 1, y), "x int, z double, y int", "t", ["x", "z"])
    assert list(twice) == list(alone)
    assert twice["x"].est == pytest.approx(alone["x"].est, abs=1e-9)
    constant = fit(spark, (x, y * 0), "x int, y int", "t", ["x"])
    assert [(r.est, r.se, r.odds_ratio) for r in constant.values()] == [(None, None, None)] * 2
    level = fit(spark, (["one"] * len(y), y), "f string, y int", "t", ["f"], [Factor("f")])
    assert list(level) == ["(Intercept)"]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    assert level["(Intercept)"].est == pytest.approx(math.log(n1 / n0))
    assert level["(Intercept)"].se == pytest.approx(math.sqrt(1 / n1 + 1 / n0))


def test_separated_outcomes_are_reported(spark, caplog):
    x, y = shares((1, 9, 0), (0, 0, 9))
    with caplog.at_level("WARNING"):
        table = fit(spark, (x, y), "x int, y int", "t", ["x"])
    assert table["x"].est > 5 and "did not converge" in caplog.text


def test_factor_levels_and_baselines(spark):
    """Exposure takes its first listed level as baseline, sex the alphabetical first; a level
    that does not occur gives no term; rows with an unknown covariate are dropped."""
    rng = np.random.default_rng(5)
    n = 500
    t = rng.choice(["no_barrier", "barrier"], n)
    age = rng.integers(20, 80, n).astype(float)
    sex = rng.choice(["Male", "Female"], n)
    y = (rng.random(n) < logistic(-1 + 0.8 * (t == "barrier") + 0.01 * age)).astype(int)
    ages = [None if i == 0 else a for i, a in enumerate(age.tolist())]
    factors = [Factor("transport", ("no_barrier", "barrier")), Factor("sex")]
    table = fit(
        spark, (t, ages, sex, y), "transport string, age_proxy double, sex string, y int",
        "m", ["transport", "age_proxy", "sex"], factors,
    )
    assert list(table) == ["(Intercept)", "transportbarrier", "age_proxy", "sexMale"]
    design = np.column_stack([np.ones(n), t == "barrier", age, sex == "Male"]).astype(float)
    beta, se = irls(design[1:], y[1:])
    for row, b, s in zip(table.values(), beta, se):
        assert row.est == pytest.approx(b, abs=1e-7)
        assert row.se == pytest.approx(s, abs=1e-7)


def test_separated_outcome_gives_no_overflow():
    row = coefficient_row("x", 800.0, 1.0)
    assert row[5] == math.inf


def test_no_complete_rows_give_an_empty_table(spark):
    frame = spark.createDataFrame([(1, None)], "y int, x double")
    out = odds_ratios(frame, {"y": "m"}, ["x"], [])
    assert out.count() == 0
    assert "or_hi" in out.columns
