"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; Python's bytes.split() and this pattern agree.
SPACE = "\\x20\\x09-\\x0D"

#: Rows in an Arrow batch handed to Python; Spark ends a batch at 64 MB as well, so that batches of very long texts stay small.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a detour over str."""
    return column.cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df through f, batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def held_out(column: str, mod: int, rest: int = 2) -> Column:
    """True where crc32 of the id as text leaves rest; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9, brought back by eight exact factors; absolute error below 1e-11."""
    z = x + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum((F.log(x + float(k)) for k in range(2, 9)), F.log(x + 1.0))
