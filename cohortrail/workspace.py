"""Named tables of one run: loaded sources, and derived tables built when asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from cohortrail.study import Study


class Workspace:
    """Source tables plus derived ones.

    Sources are given as functions, so a query opens only the files it reads. A derived table is
    a lazy DataFrame until ``put`` replaces it with a stored copy; queries read whichever is there.
    """

    def __init__(
        self, sources: Mapping[str, Callable[[], DataFrame]], study: Study | None = None
    ):
        self.study = study or Study()
        self._sources = dict(sources)
        self._tables: dict[str, DataFrame] = {}
        self._stored: set[str] = set()

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame], study: Study | None = None) -> Workspace:
        """A workspace over DataFrames at hand."""
        return cls({name: (lambda df=df: df) for name, df in tables.items()}, study)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in self._sources:
                self._tables[name] = self._sources[name]()
            else:
                self._tables[name] = self._builder(name)(self)
        return self._tables[name]

    def put(self, name: str, df: DataFrame) -> None:
        """Register a stored copy of a table."""
        self._tables[name] = df
        self._stored.add(name)

    def is_stored(self, name: str) -> bool:
        return name in self._stored

    @staticmethod
    def _builder(name: str) -> Callable[[Workspace], DataFrame]:
        from cohortrail.plans.tables import DERIVED

        if name not in DERIVED:
            raise KeyError(f"no table named {name}")
        return DERIVED[name]
