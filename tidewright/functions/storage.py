"""The folder jobs share for checkpoints and intermediate tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_scopes = threading.local()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under ``spark.checkpoint.dir``, else under the warehouse; both are shared by all executors.

    It is removed when the session's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, size: int):
    """Jobs started inside hand rows to Python in batches of about ``size`` bytes, else by their number only, however long they are."""
    return _setting(spark, BATCH_BYTES, str(size))


def write(df: DataFrame, path: str) -> None:
    """``df`` as parquet; the shuffle files of the job go when it ends, else they stay until the driver collects its garbage."""
    with _setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside are removed at the end, but for those stored with ``out``, which belong to the scope around it.

    Nothing that is read after the end may depend on a removed table: store it first.
    """
    scopes = _scopes.__dict__.setdefault("stack", [])
    scopes.append([])
    try:
        yield
    finally:
        for spark, path in scopes.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str, out: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a result that several branches of a plan use and that is much smaller than its inputs: the inputs are
    read once, lineage ends here, and Spark knows the size when it chooses joins.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    scopes = _scopes.__dict__.setdefault("stack", [])
    if len(scopes) > out:
        scopes[-1 - out].append((spark, path))
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)
