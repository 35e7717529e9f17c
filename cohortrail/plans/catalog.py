"""Every named result, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cohortrail.plans.compare import ANALYSIS_RESULTS, JOURNEY_RESULTS
from cohortrail.plans.eda import EDA_RESULTS
from cohortrail.plans.figures import FIGURES
from cohortrail.plans.qa import QA_RESULTS
from cohortrail.plans.series import SERIES
from cohortrail.plans.tables import DERIVED
from cohortrail.workspace import Workspace

TABLES: dict[str, Callable[[Workspace], DataFrame]] = {
    name: (lambda ws, name=name: ws[name]) for name in DERIVED
}

RESULTS: dict[str, Callable[[Workspace], DataFrame]] = {
    **QA_RESULTS,
    **EDA_RESULTS,
    **JOURNEY_RESULTS,
    **ANALYSIS_RESULTS,
    **FIGURES,
    **SERIES,
}

CATALOG: dict[str, Callable[[Workspace], DataFrame]] = {**TABLES, **RESULTS}
