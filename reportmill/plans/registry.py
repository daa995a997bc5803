"""Where queries are registered: name -> callable, and name -> the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportmill.operators.shared import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ONCE: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build(), stored in the shared folder for the session, as long as the tables that corpora are derived from stay what they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/part.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)))
    if key not in _ONCE:
        _ONCE[key] = store(build())
    return _ONCE[key]
