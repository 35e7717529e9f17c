"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Source timestamps carry no zone; UTC keeps calendar days the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    # Hard casts must fail the load, soft casts use try_cast.
    "spark.sql.ansi.enabled": "true",
    # Runtime coalescing, broadcast conversion and splitting of hot join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot entity may hold a third of all events: split it even where that costs one more
    # exchange (of already aggregated rows) after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Split from a quarter of the default size up.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # A task sorts an exchanged partition by patient and day, then by gap: narrow rows of numbers
    # that take up to 40 times their compressed bytes in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

#: Bytes of Parquet input to a partition of an exchange, before small ones are coalesced.
PARTITION_BYTES = 8 << 20

START_CONF = {
    # Recording a Python call site for every column expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def fit_exchanges(spark: SparkSession, input_bytes: int) -> None:
    """Partitions of an exchange by the size of the input, where that asks for more than the session
    has, so that a task's share, and with it its memory, does not grow with the tables. A number the
    session was started with stays."""
    if spark.sparkContext.getConf().contains(INITIAL_PARTITIONS):
        return
    number = -(-input_bytes // PARTITION_BYTES)
    if number > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, number)
    else:
        spark.conf.unset(INITIAL_PARTITIONS)


def build_session(app: str = "cohortrail", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; ``master`` stays unset on a cluster, where spark-submit names it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
