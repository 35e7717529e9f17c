"""Source-shaped tables derived from the generic order/event test tables.

Every table keeps all rows of the table it comes from. NULLs, unmatched keys, repeated keys and
empty codes come from the values of other columns, so that every branch of the queries is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrail.sources.raw_csv import RAW_TABLES
from cohortrail.study import Study
from cohortrail.workspace import Workspace

SAMPLE_STUDY = Study(
    questions=("q_medical", "q_daily"),
    index_groups=(
        ("ECONOMY", "Economy"),
        ("LARGE", "Large"),
        ("MEDIUM", "Medium"),
        ("PROMO", "Promo"),
    ),
    first_year=1996,
    last_year=2000,
)


# Given rather than inferred, which would cost one job per table just to plan a query.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    def read(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    return {
        "encounters": lambda: _encounters(read("lineitem"), read("orders")),
        "diagnosis": lambda: _diagnosis(read("part")),
        "sdoh": lambda: _sdoh(read("events")),
        "patients": lambda: _patients(read("customer")),
        "tiger": lambda: _tiger(read("nation")),
        "departments": lambda: _departments(read("supplier")),
        "providers": lambda: _providers(read("supplier")),
    }


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def _encounters(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    flag, line, quantity = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    admitted = F.when(
        line == "F",
        F.timestamp_add("MINUTE", (quantity * 25).cast("int"), F.col("l_shipdate")),
    )
    undated = (F.col("l_tax") > 0.075) & (F.col("l_discount") > 0.095)
    visit_date = F.when(~undated, F.to_date("l_shipdate"))
    anonymous = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("EncounterKey"),
        F.when(~anonymous, F.col("o_custkey")).alias("PatientDurableKey"),
        F.col("l_suppkey").alias("DepartmentKey"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ProviderDurableKey"),
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey")).alias("PrimaryDiagnosisKey"),
        F.col("o_orderpriority").alias("Type"),
        flag.alias("VisitType"),
        line.alias("VisitTypeDescription"),
        F.when(line == "F", F.concat(F.lit("Type "), flag)).alias("AdmissionType"),
        F.concat("o_orderstatus", F.lit(', "'), flag, F.lit('"')).alias("AdmissionSource"),
        admitted.alias("AdmissionInstant"),
        F.timestamp_add("HOUR", F.col("l_linenumber"), admitted).alias("DischargeInstant"),
        visit_date.alias("EncounterDate"),
        _flag((flag == "R") & (line == "F") & (quantity <= 6)).alias("IsEdVisit"),
        _flag(flag == "A").alias("IsHospitalAdmission"),
        _flag((flag == "N") & (line == "F")).alias("IsHospitalOutpatientVisit"),
        _flag((flag == "A") & (line == "F") & (quantity > 44)).alias("IsInpatientAdmission"),
        _flag((flag == "A") & (line == "O")).alias("IsObservation"),
        _flag((flag == "N") & (line == "O")).alias("IsOutpatientFaceToFaceVisit"),
        F.coalesce(admitted, visit_date.cast("timestamp_ntz")).alias("encounter_ts"),
    )


def _diagnosis(part: DataFrame) -> DataFrame:
    """Large sizes get a key no encounter uses; small ones share the key of the part before.

    There are more groups and values than the top-k reports show."""
    size, key = F.col("p_size"), F.col("p_partkey")
    group = F.when(size % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand"))
    return part.select(
        F.when(size > 42, -key).when(size <= 2, key - 1).otherwise(key).alias("DiagnosisKey"),
        F.concat_ws(".", "p_brand", (size % 10).cast("string")).alias("DiagnosisValue"),
        F.col("p_name").alias("DiagnosisName"),
        F.when(size != 13, group).alias("GroupCode"),
        F.when(size != 13, F.lower(group)).alias("GroupName"),
    )


def _sdoh(events: DataFrame) -> DataFrame:
    kind, minute, value = F.col("event_type"), F.minute("ts"), F.col("value")
    return events.select(
        F.col("event_id").alias("EncounterKey"),
        F.when(F.hour("ts") > 0, F.col("user_id")).alias("PatientDurableKey"),
        F.when(kind == "signup", "Transportation Needs")
        .when(kind == "view", "Stress")
        .when(kind == "click", "Depression")
        .when(kind == "purchase", "Utilities")
        .alias("Domain"),
        F.when(minute < 25, "q_medical")
        .when(minute < 50, "q_daily")
        .otherwise(F.concat(F.lit("q_other_"), minute.cast("string")))
        .alias("DisplayName"),
        F.when(value < 2, "Yes")
        .when(value < 6, "No")
        .when(value < 14, "Patient declined")
        .when(value < 18, "Patient unable to answer")
        .otherwise("Unsure")
        .alias("AnswerText"),
    )


def _patients(customer: DataFrame) -> DataFrame:
    balance, segment, nation = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")
    bin_ = (1930 + 5 * F.floor((balance + 1000) / 700)).cast("int")
    return customer.select(
        F.col("c_custkey").alias("PatientDurableKey"),
        F.when(~balance.between(0, 250), bin_).alias("BirthYearBin"),
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), "Female")
        .when(segment.isin("FURNITURE", "HOUSEHOLD"), "Male")
        .alias("SexAtBirth"),
        segment.alias("FirstRace"),
        segment.alias("OmbRace"),
        F.lower(segment).alias("OmbEthnicity"),
        F.when(nation < 12, "Married").otherwise("Single").alias("MaritalStatus"),
        F.when(nation < 5, "Activated").alias("MyChartStatus"),
        F.when(balance > 5000, "Never").otherwise("Former").alias("SmokingStatus"),
        F.when(balance < 0, "Deceased").otherwise("Alive").alias("VitalStatus"),
        F.when(nation == 15, "")
        .when(nation == 16, "*Masked")
        .when(nation > 16, (nation + 1).cast("string"))
        .alias("FipsCode"),
    )


def _tiger(nation: DataFrame) -> DataFrame:
    """One code occurs twice, and the patients' code 25 not at all."""
    key = F.col("n_nationkey")
    return nation.select(
        F.when(key == 3, "20").otherwise(key.cast("string")).alias("FipsCode"),
        (key * 1.5).cast("double").alias("lat"),
        (key * 2.5 - 100).cast("double").alias("lon"),
        (1000 * (key + 1)).cast("int").alias("Population"),
    )


def _departments(supplier: DataFrame) -> DataFrame:
    """Suppliers in debt get a key no encounter uses. Specialties hold a line break."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    number = nation.cast("string")
    return supplier.select(
        F.when(F.col("s_acctbal") < 0, -key).otherwise(key).alias("DepartmentKey"),
        F.col("s_name").alias("DepartmentName"),
        F.when(nation < 20, F.concat(F.lit("Specialty\n"), number)).alias("DepartmentSpecialty"),
        F.when(nation < 12, "*Unknown")
        .when(nation < 16, "ED")
        .otherwise("Normal")
        .alias("DepartmentType"),
        F.concat(F.lit("City, "), number).alias("City"),
        F.when(nation > 3, F.concat(F.lit('"County" '), number)).alias("County"),
        F.lpad(number, 5, F.lit("0")).alias("PostalCode"),
        F.concat(F.lit("00"), key.cast("string")).alias("DeptCensusTract"),
    )


def _providers(supplier: DataFrame) -> DataFrame:
    nation = F.col("s_nationkey")
    number = nation.cast("string")
    return supplier.select(
        (F.col("s_suppkey") * 10 + 1).alias("ProviderDurableKey"),
        F.col("s_name").alias("ClinicianTitle"),
        F.lit("Physician").alias("ProviderType"),
        F.when(nation < 20, F.concat(F.lit("Specialty "), number)).alias("PrimarySpecialty"),
        F.when(nation > 5, F.concat(F.lit('Dept "'), number, F.lit('"'))).alias("PrimaryDepartment"),
        F.concat(F.lit("City, "), number).alias("OfficeCity"),
        F.lpad(number, 5, F.lit("0")).alias("OfficePostalCode"),
    )


def write_raw(ws: Workspace, folder: str, names: list[str]) -> None:
    """Write sample tables as raw CSV files, under the header names of those. NULLs take turns
    among the null tokens, by the table's first column."""
    for name in names:
        table = RAW_TABLES[name]
        columns = []
        for field in table.fields:
            text = F.col(field.name).cast("string")
            if table.null_tokens:
                tokens = F.array(*[F.lit(token) for token in table.null_tokens])
                turn = F.pmod(F.xxhash64(table.fields[0].name), F.lit(len(table.null_tokens)))
                text = F.coalesce(text, F.get(tokens, turn.cast("int")))
            columns.append(text.alias(field.headers[-1]))
        path = f"{folder}/{table.file}"
        ws[name].select(*columns).write.option("header", True).option("escape", '"').csv(path)
