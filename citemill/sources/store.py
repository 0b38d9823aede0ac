"""Intermediate tables in the folder that driver and executors share, ``spark.checkpoint.dir``.

What must be made once, such as a model's replies, is written and read back: a lost executor then
costs a read, not another call, and no plan grows with the steps before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes an execution's shuffle files at its end; else they stay until the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that the innermost ``temporaries`` block will delete.
_open: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; only a local session (tests) may do without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/citemill/{spark.sparkContext.applicationId}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written or counted within the block leaves no shuffle files."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def stored(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """``rows`` written to the shared folder and read back, without their shuffle files; ``clear`` removes all of them."""
    path = f"{scratch_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with swept(rows.sparkSession):
        rows.write.options(**options).parquet(path)
    if _open:
        _open[-1].append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block go at its end, and shuffle files of all that is written there at once."""
    _open.append([])
    try:
        with swept(spark):
            yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has stored; for the end of a job."""
    _delete(spark, scratch_dir(spark))
