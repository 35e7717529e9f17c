"""Adjusted odds ratios from a binomial model with logit link."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

log = logging.getLogger(__name__)

MAX_ITERATIONS = 25

# Fixed value: normal quantile of the Wald interval.
WALD_Z = 1.96

COEFFICIENT_SCHEMA = (
    "term string, est double, se double, z double, p double, "
    "odds_ratio double, or_lo double, or_hi double, model string"
)


@dataclass(frozen=True)
class Factor:
    """A categorical covariate; the first level is the baseline, sorted levels if not given."""

    name: str
    levels: tuple[str, ...] | None = None


def _terms(cells: DataFrame, numeric: list[str], factors: list[Factor], order: list[str]):
    """(term name, design column) pairs in model order; absent levels give no term."""
    found = {}
    if factors:
        sets = cells.agg(*[F.collect_set(f.name).alias(f.name) for f in factors]).first()
        found = {f.name: set(sets[f.name]) for f in factors}
    by_name = {f.name: f for f in factors}
    terms = []
    for name in order:
        if name in numeric:
            terms.append((name, F.col(name).cast("double")))
            continue
        levels = by_name[name].levels or tuple(sorted(found[name]))
        present = [level for level in levels if level in found[name]]
        for level in present[1:]:
            terms.append((f"{name}{level}", (F.col(name) == level).cast("double")))
    return terms


def odds_ratios(
    frame: DataFrame,
    outcomes: dict[str, str],
    covariates: list[str],
    factors: list[Factor],
) -> DataFrame:
    """Coefficient table of one model per outcome column, intercept first.

    The model frame is reduced to covariate patterns with counts of ones and zeros, one shuffle
    for all outcomes. A weighted fit on those has the same likelihood, coefficients and standard
    errors as a fit on the rows, while each iteration touches only the patterns: a few hundred
    when the covariates are discrete. Only the coefficient rows reach the driver.
    """
    spark = frame.sparkSession
    factor_names = {f.name for f in factors}
    numeric = [c for c in covariates if c not in factor_names]
    cells = (
        frame.na.drop(subset=covariates)
        .groupBy(*covariates)
        .agg(
            *[F.count_if(F.col(y) == 1).cast("double").alias(f"{y}_1") for y in outcomes],
            *[F.count_if(F.col(y) == 0).cast("double").alias(f"{y}_0") for y in outcomes],
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    rows = []
    try:
        if not cells.isEmpty():
            terms = _terms(cells, numeric, factors, covariates)
            for outcome, label in outcomes.items():
                rows += [(*row, label) for row in _fit(cells, terms, outcome)]
    finally:
        cells.unpersist()
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def _fit(cells: DataFrame, terms, outcome: str) -> list[tuple]:
    """One weighted fit; each pattern enters as its share of ones, weighted by its rows.

    A term that the intercept and earlier terms determine is left out. An outcome that never
    varies has no finite fit: its rows carry NULLs. Reaching the last iteration is logged.
    """
    ones, zeros = F.col(f"{outcome}_1"), F.col(f"{outcome}_0")
    terms, n_ones, n_zeros = _estimable(cells.where(ones + zeros > 0), terms, ones, zeros)
    names = ["(Intercept)", *(name for name, _ in terms)]
    if not n_ones or not n_zeros:
        log.warning("%s does not vary: no coefficients", outcome)
        return [coefficient_row(name, None, None) for name in names]
    if not terms:
        error = math.sqrt(1 / n_ones + 1 / n_zeros)
        return [coefficient_row("(Intercept)", math.log(n_ones / n_zeros), error)]
    columns = [f"x{i}" for i in range(len(terms))]
    design = cells.where(ones + zeros > 0).select(
        *[column.alias(name) for name, (_, column) in zip(columns, terms)],
        (ones / (ones + zeros)).alias("y"),
        (ones + zeros).alias("w"),
    )
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(design)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="y", weightCol="w",
        regParam=0.0, tol=1e-10, maxIter=MAX_ITERATIONS,
    ).fit(assembled)
    if model.summary.numIterations >= MAX_ITERATIONS:
        log.warning("the model of %s did not converge in %d iterations", outcome, MAX_ITERATIONS)
    # The summary lists the intercept last; the table starts with it.
    estimates = [model.intercept, *model.coefficients.toArray().tolist()]
    errors = list(model.summary.coefficientStandardErrors)
    errors = [errors[-1], *errors[:-1]]
    return [
        coefficient_row(name, est, se)
        for name, est, se in zip(names, estimates, errors)
    ]


def _estimable(cells: DataFrame, terms, ones, zeros):
    """The terms that are no combination of the intercept and earlier ones, and the numbers of
    ones and zeros, from one row of sums of products over the patterns."""
    design = [F.lit(1.0), *(column for _, column in terms)]
    pairs = [(i, j) for i in range(len(design)) for j in range(i + 1)]
    sums = cells.agg(
        F.sum(ones).alias("ones"),
        F.sum(zeros).alias("zeros"),
        *[F.sum((ones + zeros) * design[i] * design[j]).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    product = {(i, j): sums[f"p{i}_{j}"] or 0.0 for i, j in pairs}
    factor: dict[int, dict[int, float]] = {}
    for i in range(len(design)):
        row: dict[int, float] = {}
        for k in factor:
            done = sum(row[m] * factor[k][m] for m in row if m in factor[k])
            row[k] = (product[i, k] - done) / factor[k][k]
        rest = product[i, i] - sum(v * v for v in row.values())
        if rest > 1e-9 * max(product[i, i], 1e-300):
            factor[i] = {**row, i: math.sqrt(rest)}
    kept = [term for i, term in enumerate(terms, start=1) if i in factor]
    return kept, sums["ones"] or 0.0, sums["zeros"] or 0.0


def coefficient_row(term: str, est: float | None, se: float | None) -> tuple:
    """Wald test and odds ratio with its interval for one coefficient; NULL where there is none."""
    if est is None:
        return (term, *[None] * 7)
    if not se:
        return (term, float(est), None, None, None, _exp(est), None, None)
    z = est / se
    p = math.erfc(abs(z) / math.sqrt(2.0))
    return (
        term, float(est), float(se), z, p,
        _exp(est), _exp(est - WALD_Z * se), _exp(est + WALD_Z * se),
    )


def _exp(x: float) -> float:
    """Infinity instead of an overflow error, for outcomes that a covariate separates."""
    return math.exp(x) if x < 709.0 else math.inf
