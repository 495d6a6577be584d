"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Bytes of an Arrow batch (about; a longer row makes one of its own). Spark's default is 64 MB, which an executor holds
#: several times over for each running task: in its own buffers, in the worker's and in the worker's copies.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand texts to Python in batches of ``BATCH_BYTES``; that lowers memory and alters no result."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation of all before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/probeloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[tuple[SparkSession, str]]:
    """What ``cut`` has written and nobody has deleted yet."""
    return list(_made)


def drop(some: list[tuple[SparkSession, str]]) -> None:
    """Delete tables of ``tables()``; call it when no result that reads them is needed any more."""
    for spark, path in some:
        if (spark, path) in _made:
            _made.remove((spark, path))
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release() -> None:
    """Delete all tables that ``cut`` has written."""
    drop(tables())


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session has ended before: the cluster's own cleaning of the folder remains
        _made.clear()
