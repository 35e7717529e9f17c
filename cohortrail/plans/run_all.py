"""The whole analysis as a batch run: load, audit, describe, derive, compare, export."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Collection, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrail.plans import figures
from cohortrail.plans.compare import ANALYSIS_RESULTS, JOURNEY_RESULTS
from cohortrail.plans.eda import EDA_RESULTS
from cohortrail.plans.qa import QA_RESULTS
from cohortrail.plans.sketches import patient_sketches
from cohortrail.plans.series import SERIES, SERIES_AXES, line_chart_axis
from cohortrail.plans.tables import PATIENT
from cohortrail.sources.raw_csv import RAW_TABLES, check_inputs, load
from cohortrail.sources.scratch import scratch_dir
from cohortrail.sources.store import (
    Buckets,
    Manifest,
    input_files,
    read_result,
    read_table,
    replace_buckets,
    rows_beside,
    table_is_complete,
    write_result,
    write_table,
)
from cohortrail.study import Study
from cohortrail.workspace import Workspace

log = logging.getLogger("cohortrail")

# Derived tables written by the load and journey stages, each after those it reads.
LOAD_TABLES = ["diagnosis_dedup"]
JOURNEY_TABLES = [
    "patient_transport", "patient_days", "patient_journey", "patient_gaps", "chronic_index", "chronic_followup",
    "patient_analytic",
]

# Described after the journey where quantiles are approximate: they come from its sketches.
FROM_SKETCHES = ("eda_enc_per_patient",)

# How the rows of a stored table are ranged over its files: date filters then skip most of them.
TABLE_ORDER = {"encounters": ("encounter_ts", "EncounterKey")}

# Tables whose rows are dealt to files by patient: each has few rows to a patient (at most one per
# calendar day), so that no file is a hot patient's. Encounters stay ranged by time.
BUCKETED = {"patients", *JOURNEY_TABLES}

# Tables that may get further parts, each in a folder of its own that counts once the manifest lists
# it: a refresh that is lost half way is run again without counting a row twice.
GROWING = {"encounters"}
FIRST_PART = "first"

# Columns of the result files the figures read back, in the order written.
RESULT_SCHEMAS = {
    "an_headline_by_transport": (
        "transport_status string, n_patients long, mean_enc double, median_enc double, "
        "mean_ed double, median_ed double, pct_any_ed double, pct_any_inpat double, "
        "pct_any_obs double, mean_age double, median_gap_days double, median_gap_q75 double"
    ),
    "an_annualized_rates_by_transport": (
        "transport_status string, n_patients long, total_ed long, total_enc long, "
        "total_days_observed long, ed_per_person_year double, inpat_per_person_year double"
    ),
    "an_setting_mix_by_transport": (
        "transport_status string, share_ed double, share_inpatient double, share_opf2f double, "
        "share_hod double, share_obs double, total_encs long, n_patients long"
    ),
    "an_chronic_followup_by_transport": (
        "GroupCode string, transport_status string, GroupName string, n_patients long, "
        "days_q25 double, days_median double, days_q75 double, pct_fu_30 double, "
        "pct_fu_90 double, pct_fu_180 double, mean_visits_90d double, mean_ed_180d double, "
        "pct_any_ed_180 double"
    ),
    "an_logit_or_transport": (
        "term string, est double, se double, z double, p double, odds_ratio double, "
        "or_lo double, or_hi double, model string"
    ),
}

# The same for the rate series, which the axes of their charts read back.
SERIES_MEASURES = (
    "cohort string, metric string, value double, n_ed long, person_years double, "
    "n_patients long, pct_any_ed double"
)
SERIES_SCHEMAS = {
    "ed_by_year": f"year int, {SERIES_MEASURES}",
    "ed_by_quarter": (
        f"year int, quarter int, period_start date, t double, period_label string, {SERIES_MEASURES}"
    ),
}


@contextmanager
def timed(label: str) -> Iterator[None]:
    """Log the seconds a stage took or failed after; it must write its result inside the block."""
    started = time.perf_counter()
    try:
        yield
    except Exception:
        log.error("[%6.1fs] %s failed", time.perf_counter() - started, label)
        raise
    log.info("[%6.1fs] %s", time.perf_counter() - started, label)


class Run:
    """One output folder: ``tables`` for stored tables, ``manifests`` for what they were made from,
    ``results`` for result files."""

    def __init__(
        self, spark: SparkSession, src: str, out: str, study: Study, buckets: int | None = None
    ):
        self.spark, self.src, self.out = spark, src, out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        sources = {name: (lambda n=name: self._stored(n)) for name in RAW_TABLES}
        self.ws = Workspace(sources, study)

    def table_path(self, name: str) -> str:
        return f"{self.out}/tables/{name}"

    def result_path(self, name: str) -> str:
        return f"{self.out}/results/{name}.csv"

    def manifest_path(self, name: str) -> str:
        return f"{self.out}/manifests/{name}.json"

    def manifest(self, name: str) -> Manifest | None:
        return Manifest.read(self.spark, self.manifest_path(name))

    def _study(self) -> dict[str, object]:
        """The study's parameters as they read back from a manifest."""
        return json.loads(json.dumps(asdict(self.ws.study)))

    def _inputs(self, name: str) -> list[list]:
        """The files a loaded table is read from."""
        table = RAW_TABLES.get(name)
        return input_files(self.spark, f"{self.src}/{table.file}") if table else []

    def _stored(self, name: str) -> DataFrame:
        manifest = self.manifest(name)
        if manifest is None:
            return read_table(self.spark, self.table_path(name))
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        buckets = Buckets(PATIENT, manifest.buckets) if manifest.buckets else None
        return read_table(self.spark, self.table_path(name), schema, buckets, manifest.parts)

    def _store(self, name: str, df: DataFrame) -> None:
        """Write a table and its manifest; the counts in the log are observed by the write."""
        inputs = self._inputs(name)
        buckets = Buckets(PATIENT, self.buckets) if name in BUCKETED else None
        parts = [FIRST_PART] if name in GROWING else []
        path = "/".join([self.table_path(name), *parts])
        with timed(name):
            metrics = write_table(
                df, path, TABLE_ORDER.get(name, ()), buckets, PATIENT, "encounter_ts"
            )
        log.info("%s: %s", name, ", ".join(f"{k} {v}" for k, v in metrics.items()))
        Manifest(
            df.schema.json(), self._study(), inputs, metrics, buckets.number if buckets else 0, parts
        ).write(self.spark, self.manifest_path(name))
        self.ws.put(name, self._stored(name))

    def _is_complete(self, name: str) -> bool:
        manifest = self.manifest(name)
        parts = manifest.parts if manifest is not None else ()
        paths = [f"{self.table_path(name)}/{part}" for part in parts] or [self.table_path(name)]
        return all(table_is_complete(self.spark, path) for path in paths)

    def _results(self, results: Mapping[str, Callable[[Workspace], DataFrame]]) -> None:
        for name, build in results.items():
            with timed(name):
                write_result(build(self.ws), self.result_path(name))

    def _load(self, name: str, multiline: Collection[str]) -> None:
        self._store(name, load(self.spark, self.src, name, name in multiline or None))

    def load(self, multiline: Collection[str] = ()) -> None:
        check_inputs(self.spark, self.src)
        for name in RAW_TABLES:
            self._load(name, multiline)
        for name in LOAD_TABLES:
            self._store(name, self.ws[name])
        self.audit()

    def audit(self) -> None:
        self._results(QA_RESULTS)

    def stale_tables(self) -> list[str]:
        """Loaded tables whose source files are there, but are not those it was loaded from."""
        stale = []
        for name in RAW_TABLES:
            inputs, manifest = self._inputs(name), self.manifest(name)
            if inputs and manifest is not None and not manifest.is_of(inputs):
                stale.append(name)
        return stale

    def use_loaded(self, multiline: Collection[str] = (), refresh: bool = False) -> None:
        """Take the loaded tables of an earlier run of the same study.

        Tables whose source files have changed since are named and loaded again. Where the source
        files are gone, the tables are taken as they are.
        """
        names = [*RAW_TABLES, *LOAD_TABLES]
        absent = [n for n in names if not self._is_complete(n)]
        if absent:
            raise FileNotFoundError(f"not loaded yet in {self.out}: {', '.join(absent)}")
        for name in names:
            manifest, study = self.manifest(name), self._study()
            before = study if manifest is None else dict(manifest.study)
            changed = sorted(k for k in {*study, *before} if study.get(k) != before.get(k))
            if changed:
                raise ValueError(
                    f"{name} in {self.out} is of a study with other parameters: {', '.join(changed)}"
                )
        stale = [n for n in self.stale_tables() if not (refresh and n in GROWING)]
        if refresh and stale:
            raise ValueError(f"source files have changed, load again: {', '.join(stale)}")
        for name in names:
            if name in stale:
                log.warning("%s: source files have changed, loading again", name)
                self._load(name, multiline)
            elif name in LOAD_TABLES and stale:
                self._store(name, self.ws[name])
            else:
                self.ws.put(name, self._stored(name))

    def _added_files(self, name: str) -> list[list]:
        """Source files that have come since the table was loaded; the others must be the same."""
        manifest, inputs = self.manifest(name), self._inputs(name)
        if manifest is None:
            raise FileNotFoundError(f"not loaded yet in {self.out}: {name}")
        before = [list(x) for x in manifest.inputs]
        if any(x not in inputs for x in before):
            raise ValueError(f"{name}: source files have changed or gone, load again")
        return [x for x in inputs if x not in before]

    def refresh(self, multiline: Collection[str] = ()) -> list[str]:
        """Take in further parts of the encounters' folder; only the patients in them are computed
        again. Returns the names of the parts.

        The journey tables keep their other buckets as they are; a bucket with a touched patient is
        written again from its other patients' stored rows and the touched ones' new rows, which are
        computed from all their encounters, so a repeated refresh gives the same tables.
        """
        name = "encounters"
        self.use_loaded(multiline, refresh=True)
        added, manifest = self._added_files(name), self.manifest(name)
        if not added:
            for table in JOURNEY_TABLES:
                self.ws.put(table, self._stored(table))
            return []
        names = [x[0] for x in added]
        part = f"added-{hashlib.md5(json.dumps(added).encode()).hexdigest()}"
        new = load(self.spark, self.src, name, name in multiline or None, names)
        with timed(f"{name}: {', '.join(names)}"):
            metrics = write_table(
                new, f"{self.table_path(name)}/{part}", TABLE_ORDER[name], None, PATIENT, "encounter_ts"
            )
        log.info("%s: %s added", name, ", ".join(f"{k} {v}" for k, v in metrics.items()))
        parts = [*(p for p in manifest.parts if p != part), part]
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        encounters = read_table(self.spark, self.table_path(name), schema, None, parts)

        scratch = scratch_dir(self.spark, "refresh")

        def staged(table: str, df: DataFrame) -> DataFrame:
            write_table(df, f"{scratch}/{table}")
            return read_table(self.spark, f"{scratch}/{table}", df.schema)

        added_rows = read_table(self.spark, self.table_path(name), schema, None, [part])
        touched = staged("touched", added_rows.select(PATIENT).distinct())

        def of_touched(df: DataFrame) -> DataFrame:
            keys = touched.select(F.col(PATIENT).alias("touched_key"))
            return df.join(keys, F.col(PATIENT).eqNullSafe(F.col("touched_key")), "left_semi")

        tables = {n: self.ws[n] for n in (*RAW_TABLES, *LOAD_TABLES)}
        tables |= {n: of_touched(self.ws[n]) for n in ("sdoh", "patients")}
        theirs = Workspace.of(tables | {name: of_touched(encounters)}, self.ws.study)
        for table in JOURNEY_TABLES:
            fresh = staged(f"fresh/{table}", theirs[table])
            theirs.put(table, fresh)
            before = self.manifest(table)
            buckets = Buckets(PATIENT, before.buckets)
            shape = T.StructType.fromJson(json.loads(before.schema))
            path = self.table_path(table)
            with timed(table):
                beside = rows_beside(self.spark, path, shape, buckets, touched)
                whole = staged(f"whole/{table}", beside.unionByName(fresh))
                replace_buckets(whole, path, shape, buckets)
            self.ws.put(table, self._stored(table))
        replace(manifest, inputs=self._inputs(name), metrics={}, parts=parts).write(
            self.spark, self.manifest_path(name)
        )
        self.ws.put(name, self._stored(name))
        return names

    def describe(self) -> None:
        later = FROM_SKETCHES if self.ws.study.approx else ()
        self._results({n: build for n, build in EDA_RESULTS.items() if n not in later})

    def journey(self) -> None:
        for name in JOURNEY_TABLES:
            self._store(name, self.ws[name])

    def report(self) -> None:
        """What the journey tables show, with their sketches if quantiles are approximate."""
        if self.ws.study.approx:
            self._store("patient_sketches", patient_sketches(self.ws))
            self._results({name: EDA_RESULTS[name] for name in FROM_SKETCHES})
        self._results(JOURNEY_RESULTS)

    def compare(self) -> None:
        self._results(ANALYSIS_RESULTS)

    def figures(self) -> None:
        """Chart data from the result files, the age density from the patient table."""
        study = self.ws.study
        read = {
            name: read_result(self.spark, self.result_path(name), schema)
            for name, schema in RESULT_SCHEMAS.items()
        }
        shares = read["an_headline_by_transport"].select(
            "transport_status", "n_patients", "pct_any_ed", "pct_any_inpat"
        )
        rates = read["an_annualized_rates_by_transport"].select(
            "transport_status", "ed_per_person_year", "inpat_per_person_year"
        )
        mix = read["an_setting_mix_by_transport"]
        chronic = read["an_chronic_followup_by_transport"]
        odds = read["an_logit_or_transport"]
        self._results(
            {
                "fig1_signature": lambda ws: figures.signature(
                    shares.join(rates, "transport_status"), study
                ),
                "fig2_adjusted_or": lambda ws: figures.adjusted_or(odds, study),
                "fig3_setting_mix_long": lambda ws: figures.setting_mix_long(mix, study),
                "fig3_setting_mix_wide": lambda ws: figures.setting_mix_wide(mix, study),
                "fig4_chronic_ed_180d": lambda ws: figures.chronic_ed(chronic, study),
                "fig5_age_density": figures.age_density,
            }
        )

    def series(self) -> None:
        """The rate series, and the axes of their charts from the result files."""
        self._results({name: SERIES[name] for name in SERIES_SCHEMAS})
        for name, schema in SERIES_SCHEMAS.items():
            x, pad = SERIES_AXES[name]
            read = read_result(self.spark, self.result_path(name), schema)
            axis = line_chart_axis(read, x, pad)
            self._results({f"{name}_axis": lambda ws, axis=axis: axis})


def run_all(
    spark: SparkSession,
    src: str,
    out: str,
    skip_etl: bool = False,
    study: Study | None = None,
    multiline: Collection[str] = (),
    buckets: int | None = None,
    refresh: bool = False,
) -> Run:
    """Run every stage; ``skip_etl`` starts from the tables an earlier run loaded, ``multiline``
    names the tables whose quoted fields may hold line breaks, ``buckets`` is the number of files
    of a table stored by patient. ``refresh`` starts from the stored tables of an earlier run, and
    computes again only the patients that occur in further parts of the encounters."""
    run = Run(spark, src, out, study or Study(), buckets)
    if refresh:
        run.refresh(multiline)
        run.audit()
    elif skip_etl:
        run.use_loaded(multiline)
    else:
        run.load(multiline)
    run.describe()
    if not refresh:
        run.journey()
    run.report()
    for stage in (run.compare, run.figures, run.series):
        stage()
    return run
