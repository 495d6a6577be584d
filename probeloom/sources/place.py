"""Folders for tables that a job writes and reads again, where all executors see them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path (deleted at the program's end) in ``spark.checkpoint.dir``; a temporary one only for a local session without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/probeloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written into a shared folder and read back: its plan ends there, and a lost executor costs a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> list[tuple[SparkSession, str]]:
    """The folders that are still there."""
    return list(_made)


def drop(some: list[tuple[SparkSession, str]]) -> None:
    """Delete folders of ``tables()``; call it when no result that reads them is needed any more."""
    for spark, path in some:
        if (spark, path) in _made:
            _made.remove((spark, path))
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def release() -> None:
    """Delete all these folders; at the program's end at the latest, if the session still lives."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # else the cluster's own cleaning of the folder remains
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
