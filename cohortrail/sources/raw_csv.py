"""The seven raw CSV files: which columns are kept, under which name and type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrail.sources.store import path_exists


@dataclass(frozen=True)
class Field:
    """One kept column: its name, its kind, and the header names accepted for it."""

    name: str
    kind: str
    headers: tuple[str, ...]


@dataclass(frozen=True)
class RawTable:
    """One CSV file. Without null tokens an empty field is NULL; tokens replace that rule, so
    an empty field then stays empty text. With ``multiline`` a quoted field may hold line breaks,
    at the price of one task per file."""

    file: str
    fields: tuple[Field, ...]
    null_tokens: tuple[str, ...] = ()
    multiline: bool = False


def _field(kind: str, name: str, *headers: str) -> Field:
    return Field(name, kind, headers or (name,))


def _texts(*names: str) -> tuple[Field, ...]:
    return tuple(_field("text", name) for name in names)


# File names, header names and null tokens of the source extract.
RAW_TABLES = {
    "patients": RawTable(
        "patients.csv",
        (
            _field("required_long", "PatientDurableKey", "DurableKey"),
            _field("int", "BirthYearBin", "PatientBirthYearBin"),
            _field("text", "SexAtBirth", "SexAssignedAtBirth"),
            *_texts(
                "FirstRace", "OmbRace", "OmbEthnicity", "MaritalStatus", "MyChartStatus",
                "SmokingStatus", "VitalStatus",
            ),
            _field("text", "FipsCode", "CensusBlockGroupFipsCode"),
        ),
        null_tokens=("NA", "*Unspecified", "*Unknown"),
    ),
    "diagnosis": RawTable(
        "diagnosis.csv",
        (
            _field("long", "DiagnosisKey"),
            *_texts("DiagnosisValue", "DiagnosisName", "GroupCode", "GroupName"),
        ),
    ),
    "departments": RawTable(
        "departments.csv",
        (
            _field("long", "DepartmentKey"),
            _field("text", "DepartmentName", "DepartmentName", "Department Name"),
            *_texts("DepartmentSpecialty", "DepartmentType", "City", "County", "PostalCode"),
            _field("text", "DeptCensusTract", "CensusTract"),
        ),
    ),
    "providers": RawTable(
        "providers.csv",
        (
            _field("long", "ProviderDurableKey", "DurableKey"),
            _field("text", "ClinicianTitle"),
            _field("text", "ProviderType", "Type"),
            *_texts("PrimarySpecialty", "PrimaryDepartment", "OfficeCity", "OfficePostalCode"),
        ),
    ),
    "tiger": RawTable(
        "tigercensuscodes.csv",
        (
            _field("text", "FipsCode", "GEOID"),
            _field("double", "lat", "CENTLAT"),
            _field("double", "lon", "CENTLON", "CENTLONG"),
            _field("int", "Population", "PopulationValue", "Population"),
        ),
    ),
    "sdoh": RawTable(
        "social_determinants.csv",
        (
            _field("long", "EncounterKey"),
            _field("long", "PatientDurableKey"),
            *_texts("Domain", "DisplayName", "AnswerText"),
        ),
    ),
    "encounters": RawTable(
        "encounters.csv",
        (
            _field("long", "EncounterKey"),
            _field("long", "PatientDurableKey"),
            _field("long", "DepartmentKey"),
            _field("long", "ProviderDurableKey"),
            _field("long", "PrimaryDiagnosisKey"),
            *_texts("Type", "VisitType", "VisitTypeDescription", "AdmissionType", "AdmissionSource"),
            _field("timestamp", "AdmissionInstant"),
            _field("timestamp", "DischargeInstant"),
            _field("date", "EncounterDate", "Date"),
            _field("flag", "IsEdVisit"),
            _field("flag", "IsHospitalAdmission"),
            _field("flag", "IsHospitalOutpatientVisit"),
            _field("flag", "IsInpatientAdmission"),
            _field("flag", "IsObservation"),
            _field("flag", "IsOutpatientFaceToFaceVisit"),
        ),
    ),
}


def missing_inputs(spark: SparkSession, src: str) -> list[str]:
    return [t.file for t in RAW_TABLES.values() if not path_exists(spark, f"{src}/{t.file}")]


def check_inputs(spark: SparkSession, src: str) -> None:
    """Stop before any job if one of the seven files is absent."""
    missing = missing_inputs(spark, src)
    if missing:
        raise FileNotFoundError(f"missing in {src}: {', '.join(missing)}")


def load(
    spark: SparkSession,
    src: str,
    name: str,
    multiline: bool | None = None,
    parts: Sequence[str] = (),
) -> DataFrame:
    """Read one raw table, or only these parts of its folder, with its kept columns cleaned and typed.

    Every field is read as text, by header name. A record with too few or too many fields fails
    the load, and so does a line break in quotes unless ``multiline`` (by default the table's own
    setting) accepts it; parts of a folder whose header differs from the first part's fail, too.
    Whole records are parsed for that, not only the kept columns.
    """
    table = RAW_TABLES[name]
    path = f"{src}/{table.file}"
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", table.multiline if multiline is None else multiline)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .option("enforceSchema", False)
    )
    # Given as a schema, the first header is checked against that of every part.
    paths = [f"{path}/{part}" for part in parts] or [path]
    raw = reader.schema(reader.csv(paths).schema).csv(paths)
    df = raw.select(*[_typed(raw, field, table).alias(field.name) for field in table.fields])
    return with_event_time(df) if name == "encounters" else df


def with_event_time(encounters: DataFrame) -> DataFrame:
    """Admission time if known, otherwise midnight of the encounter date."""
    midnight = F.col("EncounterDate").cast("timestamp_ntz")
    return encounters.withColumn("encounter_ts", F.coalesce("AdmissionInstant", midnight))


def _typed(raw: DataFrame, field: Field, table: RawTable) -> Column:
    found = [h for h in field.headers if h in raw.columns]
    if not found:
        raise ValueError(f"{table.file} has no column {' or '.join(field.headers)}")
    text = raw[f"`{found[0]}`"]
    if table.null_tokens:
        text = F.coalesce(text, F.lit(""))
        text = F.when(~text.isin(*table.null_tokens), text)
    else:
        text = F.nullif(text, F.lit(""))
    return CASTS[field.kind](text)


def _whole(text: Column, target: str) -> Column:
    """Soft cast to a whole number; '1970.0' is 1970, text is NULL."""
    rounded = F.bround(text.try_cast("decimal(38,10)"), 0)
    return F.coalesce(text.try_cast(target), rounded.try_cast(target))


def _flag(text: Column) -> Column:
    """0/1 or true/false; anything else fails the load."""
    number = F.bround(text.cast("decimal(38,10)"), 0).cast("int")
    lower = F.lower(text)
    return F.when(lower == "true", 1).when(lower == "false", 0).otherwise(number)


CASTS = {
    "required_long": lambda text: text.cast("bigint"),
    "long": lambda text: _whole(text, "bigint"),
    "int": lambda text: _whole(text, "int"),
    "double": lambda text: text.try_cast("double"),
    "text": lambda text: text,
    "timestamp": lambda text: text.try_cast("timestamp_ntz"),
    "date": lambda text: text.try_cast("date"),
    "flag": _flag,
}
