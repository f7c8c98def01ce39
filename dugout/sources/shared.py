"""The folder every executor can reach, for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: paths written in this process, by application
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Without either, a folder below the warehouse. On a cluster that has to be one that all machines reach, and not a
    folder of the driver's own.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{warehouse}/checkpoints"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, with scheme and host, so that it means the same to every reader."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/dugout/{label}-{uuid.uuid4().hex}")
    path = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Use it where a result is read more than once: the input is scanned a single time, the
    file size lets the planner pick its joins, and a lost executor costs nothing.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; results read from it are gone then."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(target.getFileSystem(conf).delete(target, True))
    return removed
