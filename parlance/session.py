"""What a session needs for Python functions on its executors, and the folder that its executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import uuid

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the Python path of the workers; on a cluster, pass the package with --py-files instead."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    # freed Arrow and numpy buffers go back to the system: workers outlive their tasks
    env.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "33554432"})
    return spark


def bounded(spark: SparkSession, most: int = 8 << 20) -> SparkSession:
    """As `ship`, and no more bytes in the Arrow batches that workers get, where the session has a higher bound (Spark's is 64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
        spark.conf.set(key, str(most))
    return ship(spark)


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables: spark.checkpoint.dir; where it is unset, one in the warehouse, if all executors see that."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if re.match("file:|/", warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(warehouse, "_scratch")


def folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, removed when the process ends, if its session still runs."""
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_FOLDERS: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for path, spark in _FOLDERS.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
