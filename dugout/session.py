"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Call-site capture costs a round trip per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """Session on one machine, for tests and benchmarks.

    Its shared folder is ``checkpoint_dir``, else the configured one, else a temporary one.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("dugout")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", ""):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dugout-"))
    return spark


def side_by_side(spark: SparkSession, fn: Callable, items: Sequence, workers: int = 4) -> list:
    """Run independent actions from a few driver threads, so that their jobs overlap."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that a session may be started from any folder.

    Done once per application; a cluster that installs the package on every node does not need it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # Only the driver reads this file; Spark serves it to the executors.
    archive = Path(tempfile.mkdtemp(prefix="dugout-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
