"""Stored tables (Parquet) and result files (CSV)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hadoop(spark: SparkSession, path: str):
    """A path and the file system that it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path, file_system = _hadoop(spark, path)
    return file_system.exists(hadoop_path)


def input_files(spark: SparkSession, path: str) -> list[list]:
    """Name below ``path``, length and modification time of its files, or of itself; sorted."""
    hadoop_path, file_system = _hadoop(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    root = file_system.makeQualified(hadoop_path).toString()
    found, files = [], file_system.listFiles(hadoop_path, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString().removeprefix(root).lstrip("/")
        if not name.rpartition("/")[2].startswith(("_", ".")):
            found.append([name, status.getLen(), status.getModificationTime()])
    return sorted(found)


@dataclass(frozen=True)
class Buckets:
    """Rows of a stored table are dealt to ``number`` files by a hash of ``key``: joins and
    aggregations on it then need no exchange. Each file is a partition of its own, named by
    ``COLUMN``, so that the buckets of some keys can be written again alone."""

    key: str
    number: int

    COLUMN = "bucket_number"

    def of(self) -> Column:
        """The bucket of a row, as Spark deals rows to files."""
        return F.pmod(F.hash(self.key), F.lit(self.number))


@dataclass(frozen=True)
class Manifest:
    """What a stored table was made from and what is in it."""

    schema: str
    study: Mapping[str, object] = field(default_factory=dict)
    inputs: Sequence[Sequence] = ()
    metrics: Mapping[str, object] = field(default_factory=dict)
    buckets: int = 0
    #: Folders below the table's that hold its rows; none: the table's own.
    parts: Sequence[str] = ()

    def write(self, spark: SparkSession, path: str) -> None:
        hadoop_path, file_system = _hadoop(spark, path)
        stream = file_system.create(hadoop_path, True)
        try:
            stream.write(bytearray(json.dumps(asdict(self)).encode()))
        finally:
            stream.close()

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest | None:
        hadoop_path, file_system = _hadoop(spark, path)
        if not file_system.exists(hadoop_path):
            return None
        stream = file_system.open(hadoop_path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return cls(**json.loads(text))

    def is_of(self, inputs: Sequence[Sequence]) -> bool:
        """Whether the table was made from these files."""
        return [list(x) for x in self.inputs] == [list(x) for x in inputs]


def _catalog_name(path: str) -> str:
    """The session catalog's name of the table stored at a path."""
    return f"stored_{hashlib.md5(path.encode()).hexdigest()}"


def _metrics(df: DataFrame, key: str | None, ts: str | None) -> list[Column]:
    measures = [F.count(F.lit(1)).alias("rows")]
    if key in df.columns:
        measures.append(F.count_if(F.col(key).isNull()).alias("null_keys"))
    if ts in df.columns:
        measures += [F.min(ts).cast("string").alias("first"), F.max(ts).cast("string").alias("last")]
    return measures


def write_table(
    df: DataFrame,
    path: str,
    order: Sequence[str] = (),
    buckets: Buckets | None = None,
    key: str | None = None,
    ts: str | None = None,
) -> dict[str, object]:
    """Store a table, and return its rows, NULL keys and time range, observed while it is written.

    ``order`` ranges the rows over the files by these columns, so that filters on the first one
    skip files and row groups; further columns split a value that many rows share. ``buckets`` deals
    them by a key instead, which must have few rows to a value.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if buckets:
        df = _dealt(df, buckets)
    observed = Observation()
    # Behind the exchange: ranging the rows reads what is below it twice.
    writer = df.observe(observed, *_metrics(df, key, ts)).write.mode("overwrite")
    if buckets:
        writer = writer.format("parquet").bucketBy(buckets.number, buckets.key).sortBy(buckets.key)
        writer.partitionBy(buckets.COLUMN).option("path", path).saveAsTable(_catalog_name(path))
    else:
        writer.parquet(path)
    return dict(observed.get)


def _dealt(df: DataFrame, buckets: Buckets) -> DataFrame:
    dealt = df.withColumn(buckets.COLUMN, buckets.of()).repartition(buckets.number, buckets.key)
    return dealt.sortWithinPartitions(buckets.key)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    buckets: Buckets | None = None,
    parts: Sequence[str] = (),
) -> DataFrame:
    """A stored table; a bucketed one is made known to the session's catalog by schema and buckets."""
    if buckets is None:
        paths = [f"{path}/{part}" for part in parts] or [path]
        return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    return _bucketed(spark, path, schema, buckets).drop(buckets.COLUMN)


def _bucketed(
    spark: SparkSession, path: str, schema: T.StructType, buckets: Buckets
) -> DataFrame:
    name = _catalog_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, {buckets.COLUMN} INT) USING parquet "
            f"PARTITIONED BY ({buckets.COLUMN}) CLUSTERED BY (`{buckets.key}`) "
            f"SORTED BY (`{buckets.key}`) INTO {buckets.number} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def rows_beside(
    spark: SparkSession, path: str, schema: T.StructType, buckets: Buckets, keys: DataFrame
) -> DataFrame:
    """The rows that share a bucket with some of ``keys``, without those of the keys themselves."""
    key = buckets.key
    touched = keys.select(F.col(key).alias("touched_key"))
    numbers = keys.select(buckets.of().alias("touched_bucket")).distinct()
    return (
        _bucketed(spark, path, schema, buckets)
        .join(numbers, F.col(buckets.COLUMN) == F.col("touched_bucket"), "left_semi")
        .join(touched, F.col(key).eqNullSafe(F.col("touched_key")), "left_anti")
        .drop(buckets.COLUMN)
    )


def replace_buckets(df: DataFrame, path: str, schema: T.StructType, buckets: Buckets) -> None:
    """Write the buckets that occur in ``df`` again, and leave the others as they are. ``df`` must not
    read the table."""
    spark = df.sparkSession
    _bucketed(spark, path, schema, buckets)
    columns = [*schema.fieldNames(), buckets.COLUMN]
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        _dealt(df, buckets).select(columns).write.insertInto(_catalog_name(path), overwrite=True)
    finally:
        spark.conf.set(mode, before)


def table_is_complete(spark: SparkSession, path: str) -> bool:
    """Whether an earlier run finished writing the table."""
    return path_exists(spark, f"{path}/_SUCCESS")


def write_result(df: DataFrame, path: str) -> None:
    """A result of a few rows as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result file read back; the schema lists its columns in the order written."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
