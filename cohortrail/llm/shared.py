"""What the operators of this subpackage share: stored intermediate tables and text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrail.sources.scratch import scratch_dir

#: Rows and bytes of one Arrow batch: texts can be long, and a Python worker holds a batch whole.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


class Store:
    """Intermediate tables written to the shared folder, which also cuts their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_dir(spark, name)
        self.tables = 0
        text_batches(spark)

    def keep(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of operators that hand texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(scan: Scan) -> Scan:
    """``scan`` for mapInArrow, giving back memory every few megabytes and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for out in scan(batches):
            yield out
            size += out.nbytes
            if size > BATCH_BYTES:
                size = 0
                _give_back()
        _give_back()

    return run


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """key and text: what a row-wise operator hands to Python and takes back."""
    column = F.col(key).cast("bigint") if key == "doc_id" else F.col(key)
    return docs.select(column.alias("key"), "text")


def keyed_schema(docs: DataFrame, rest: str) -> T.StructType:
    """The key's field and those of a DDL string."""
    return T.StructType([docs.schema["key"], *T.StructType.fromDDL(rest).fields])
