"""A folder for intermediate files that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str = "cohortrail") -> str:
    """A new path under the folder the cluster names in spark.checkpoint.dir, removed at the end
    of the session.

    A temporary folder of this machine stands in for it only where driver and executors are one
    process, as in local tests. On a cluster without the setting each executor would write to
    its own disk and the read-back would find part of the rows, so that is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(
                f"set spark.checkpoint.dir to a folder that all executors share (master {master})"
            )
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(hadoop_path)
    file_system.deleteOnExit(hadoop_path)
    return path
