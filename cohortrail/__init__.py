"""Cohort and journey analytics as Spark DataFrame jobs."""

from cohortrail.session import build_session, configure
from cohortrail.study import Study
from cohortrail.workspace import Workspace

__all__ = ["Study", "Workspace", "build_session", "configure"]
