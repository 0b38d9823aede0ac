"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: With it Spark deletes an execution's shuffle files at its end; else they stay until the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes empty. Pure ASCII text takes the built-in fast path."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the folder all executors share, ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets a temporary one; a cluster is refused,
    since no folder of the driver's machine would do.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/citemill/{spark.sparkContext.applicationId}"


#: Paths that the innermost ``temporaries`` block will delete.
_open: list[list[str]] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written or counted within the block leaves no shuffle files."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; its shuffle files go at once.

    This cuts the lineage, keeps one computation for several readers, and survives lost executors.
    The files stay until ``discard``, the end of a ``temporaries`` block or ``clear_scratch``, since
    plans built later may read them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._scratch_path = path
    return table_


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialised table that no later plan reads."""
    _delete(df.sparkSession, df._scratch_path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within the block go at its end: what is to stay is written elsewhere before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def stored(df: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """What ``df()`` gives, written; the tables that it wrote for itself are deleted, and shuffle files."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with temporaries(spark), swept(spark):
        made = df()
        made.write.parquet(path)
    if _open:
        _open[-1].append(path)
    table_ = spark.read.schema(made.schema).parquet(path)
    table_._scratch_path = path
    return table_


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that this application has materialised; for the end of a job, when its results are written."""
    _delete(spark, scratch_dir(spark))


#: Rows of a range in ``running_sums``: from LEAST_RANGE up, so that few ranges are needed for very many rows.
LEAST_RANGE, MOST_RANGES = 4096, 1024
LARGE_RANGE = 1 << 20


def running_sums(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the group's rows before, in the given order.

    Groups aren't null. The order should tell all rows apart, so that any group, however large, is
    cut into ranges of bounded size; sums of the ranges before and a running sum within add up.
    """
    n = rows.count()
    ranges = max(1, min(n // LEAST_RANGE, max(MOST_RANGES, n // LARGE_RANGE)))
    cut = rows.repartitionByRange(ranges, *groups, *order).withColumn("range_", F.spark_partition_id())
    cut = materialise(cut, "ranges")
    sums = cut.groupBy(*groups, "range_").agg(F.sum(value).alias("sum_"))
    before = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, "range_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy(*groups, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("inner_", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(starts, [*groups, "range_"]).withColumn(name, F.col("start_") + F.col("inner_")).select(*rows.columns, name)
