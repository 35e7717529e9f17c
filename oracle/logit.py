"""Newton iterations for the two logistic models as a recursive DuckDB query.

Row-level and dense: one row per patient and outcome, five terms, the normal equations solved by
an unrolled Cholesky factorisation. It shares nothing with the Spark fit it checks.
"""

from __future__ import annotations

TERMS = ["(Intercept)", "transportbarrier", "age_proxy", "sexMale", "sexOther/Unknown"]
SIZE = range(len(TERMS))
ITERATIONS = 25

FRAME = """
frame AS (
  SELECT model, CAST(y AS DOUBLE) AS y, 1.0::DOUBLE AS x0,
         CAST(transport_status = 'barrier' AS INTEGER)::DOUBLE AS x1, age_proxy::DOUBLE AS x2,
         CAST(coalesce(SexAtBirth = 'Male', false) AS INTEGER)::DOUBLE AS x3,
         CAST(SexAtBirth IS NULL OR SexAtBirth NOT IN ('Male', 'Female') AS INTEGER)::DOUBLE AS x4
  FROM patient_analytic,
       LATERAL (VALUES ('any_ED', CAST(n_ed > 0 AS INTEGER)),
                       ('any_inpatient', CAST(n_inpatient > 0 AS INTEGER))) v(model, y)
  WHERE transport_status IN ('no_barrier', 'barrier') AND age_proxy IS NOT NULL
)"""


def _sums() -> str:
    """Gradient g and information h at the current coefficients, per model and iteration."""
    eta = " + ".join(f"b{i} * x{i}" for i in SIZE)
    gradient = ", ".join(f"sum(x{i} * (y - mu)) AS g{i}" for i in SIZE)
    information = ", ".join(
        f"sum(mu * (1 - mu) * x{i} * x{j}) AS h{i}{j}" for i in SIZE for j in SIZE if j <= i
    )
    keep = ", ".join(f"b{i}" for i in SIZE)
    return (
        f"SELECT model, step, {keep}, {gradient}, {information} FROM ("
        f"SELECT s.*, f.* EXCLUDE (model), 1 / (1 + exp(-({eta}))) AS mu "
        f"FROM state s JOIN frame f ON f.model = s.model) GROUP BY model, step, {keep}"
    )


def _cholesky() -> list[str]:
    columns = []
    for i in SIZE:
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            if i == j:
                columns.append(f"sqrt(h{i}{i}{inner}) AS l{i}{i}")
            else:
                columns.append(f"(h{i}{j}{inner}) / l{j}{j} AS l{i}{j}")
    return columns


def _solve() -> list[str]:
    columns = []
    for i in SIZE:
        inner = "".join(f" - l{i}{k} * u{k}" for k in range(i))
        columns.append(f"(g{i}{inner}) / l{i}{i} AS u{i}")
    for i in reversed(SIZE):
        inner = "".join(f" - l{k}{i} * d{k}" for k in range(i + 1, len(TERMS)))
        columns.append(f"(u{i}{inner}) / l{i}{i} AS d{i}")
    return columns


def _inverse_diagonal() -> list[str]:
    """Entries m of the inverse factor, then the variances as their column sums of squares."""
    columns = []
    for j in SIZE:
        for i in range(j, len(TERMS)):
            if i == j:
                columns.append(f"1 / l{j}{j} AS m{j}{j}")
            else:
                inner = " + ".join(f"l{i}{k} * m{k}{j}" for k in range(j, i))
                columns.append(f"-({inner}) / l{i}{i} AS m{i}{j}")
        total = " + ".join(f"m{i}{j} * m{i}{j}" for i in range(j, len(TERMS)))
        columns.append(f"{total} AS v{j}")
    return columns


def _table() -> str:
    start = ", ".join(f"0.0::DOUBLE AS b{i}" for i in SIZE)
    updated = ", ".join(f"b{i} + d{i} AS b{i}" for i in SIZE)
    factor, solve = ", ".join(_cholesky()), ", ".join(_solve())
    sums = _sums()
    step = (
        f"SELECT model, step + 1 AS step, {updated} FROM ("
        f"SELECT *, {factor}, {solve} FROM ({sums})) WHERE step < {ITERATIONS}"
    )
    state = (
        f"state AS (SELECT DISTINCT model, 0 AS step, {start} FROM frame UNION ALL {step})"
    )
    last = sums.replace("FROM state s", f"FROM (SELECT * FROM state WHERE step = {ITERATIONS}) s")
    errors = (
        f"errors AS (SELECT *, {factor}, {', '.join(_inverse_diagonal())} FROM ({last}))"
    )
    values = ", ".join(f"('{term}', b{i}, sqrt(v{i}))" for i, term in enumerate(TERMS))
    # erf as a series of positive terms; beyond |z| = 9 the p-value is zero to six digits.
    erf = (
        "(SELECT 2 / sqrt(pi()) * sum(exp(-q * q + 2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln(q) "
        "- lgamma(2 * n + 2.0::DOUBLE) + lgamma(n + 1.0::DOUBLE))) FROM range(400) r(n))"
    )
    coefficients = f"""
coefficients AS (
  SELECT *, exp(est) AS odds_ratio, exp(est - 1.96::DOUBLE * se) AS or_lo,
         exp(est + 1.96::DOUBLE * se) AS or_hi,
         CASE WHEN abs(z) > 9 THEN 0.0::DOUBLE ELSE 1 - {erf} END AS p
  FROM (SELECT model, term, est, se, est / se AS z,
               least(greatest(abs(est / se), 1e-9::DOUBLE), 9.0::DOUBLE) / sqrt(2.0::DOUBLE) AS q
        FROM errors, LATERAL (VALUES {values}) t(term, est, se))
)"""
    return f"WITH RECURSIVE {FRAME},\n{state},\n{errors},\n{coefficients}\n"


LOGIT_TABLE = _table()
