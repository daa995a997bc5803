"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is set, a local session gets a temporary one; a cluster is told so."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, materialised once in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint()


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the rows they led to are written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it goes when the driver's process ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def store(df: DataFrame) -> DataFrame:
    """df, written as a compressed table into the shared folder and read again; for rows too wide for cut().

    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = folder(spark, "table")
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone before
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _ranged(df: DataFrame, name: str, order: tuple, amount: Column) -> tuple[DataFrame, DataFrame]:
    """df, dealt by ranges of the order and kept, and what the ranges before each range amount to; the window has a row a range."""
    kept = cut(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias(f"{name}_range")))
    ranges = kept.groupBy(f"{name}_range").agg(amount.alias(f"{name}_all"))
    before = F.coalesce(F.sum(f"{name}_all").over(W.orderBy(f"{name}_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept, ranges.select(f"{name}_range", before.alias(f"{name}_before"))


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with the place of every row in that order, from 1, without a task that sees all rows.

    Rows are dealt by ranges of the order and kept; each range is numbered by itself, after the rows of the ranges before
    it. Rows that tie in all of the order share a range and may swap places.
    """
    kept, before = _ranged(df, name, order, F.count(F.lit(1)))
    inside = F.row_number().over(W.partitionBy(f"{name}_range").orderBy(*order))
    rows = kept.select("*", inside.alias(f"{name}_inside")).join(F.broadcast(before), f"{name}_range")
    return rows.select(*df.columns, (F.col(f"{name}_before") + F.col(f"{name}_inside")).cast("int").alias(name))


def summed(df: DataFrame, name: str, value: str, *order: str | Column) -> DataFrame:
    """df with the sum of value over the rows up to each in that order, range by range as in numbered()."""
    kept, before = _ranged(df, name, order, F.sum(value))
    inside = F.sum(value).over(W.partitionBy(f"{name}_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = kept.select("*", inside.alias(f"{name}_inside")).join(F.broadcast(before), f"{name}_range")
    return rows.select(*df.columns, (F.col(f"{name}_before") + F.col(f"{name}_inside")).alias(name))
