"""Validation of datasets, and of a new version against an old one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n) for each."""
    return reduce(DataFrame.unionByName, (d.agg(F.lit(k).alias("dataset"), F.count(F.lit(1)).alias("n")) for k, d in datasets.items()))


def uniqueness(df: DataFrame) -> DataFrame:
    """Rows and distinct rows; rows are first reduced to one each with their count, so nothing wide meets in one task."""
    each = df.groupBy(F.struct(*df.columns).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("distinct_rows"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls, blanks, low, high) in one pass."""
    s = {c: F.col(c).cast("string") for c in columns}
    one = df.agg(*(x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.count_if(F.trim(s[c]) == "").alias(f"{c}_blanks"), F.min(c).cast("string").alias(f"{c}_low"), F.max(c).cast("string").alias(f"{c}_high"))))
    parts = ", ".join(f"'{c}', `{c}_nulls`, `{c}_blanks`, `{c}_low`, `{c}_high`" for c in columns)
    return one.select(F.expr(f"stack({len(columns)}, {parts}) AS (column_name, nulls, blanks, low, high)"))


#: Leaves of the tree of digests that reconcile() compares first.
LEAVES = 65_536


def digests(df: DataFrame, keys: Sequence[str], measure: str, leaves: int = LEAVES) -> DataFrame:
    """(leaf, rows, d1, d2): for every range of key hashes, how many rows it has and two sums of their hashes.

    Equal digests are taken for equal rows: two different sets of rows would have to agree in their number and in 128 bits.
    """
    every = [*keys, measure]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *every).cast("decimal(38,0)"))
    return df.groupBy(_leaf(keys, leaves).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), total(1).alias("d1"), total(2).alias("d2"))


def _leaf(keys: Sequence[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def unequal_leaves(old: DataFrame, new: DataFrame, keys: Sequence[str], measure: str, leaves: int = LEAVES) -> DataFrame:
    """(leaf) of the ranges that differ; at most leaves rows."""
    a, b = (digests(d, keys, measure, leaves).toDF("leaf", *(f"{c}{k}" for c in ("rows", "x", "y"))) for k, d in enumerate((old, new)))
    same = F.col("rows0").eqNullSafe(F.col("rows1")) & F.col("x0").eqNullSafe(F.col("x1")) & F.col("y0").eqNullSafe(F.col("y1"))
    return a.join(b, "leaf", "full").where(~same).select("leaf")


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str], measure: str, leaves: int = LEAVES) -> DataFrame:
    """Rows on one side only, and measures that differ, by key; equal rows are left out.

    Digests of key ranges are compared first, in one pass over each side that shuffles no rows; only the rows of ranges that
    differ meet by key. Equal tables are read once and no row of them is shuffled.
    """
    differ = [r.leaf for r in unequal_leaves(old, new, keys, measure, leaves).collect()]
    if len(differ) * 2 < leaves:  # else nearly every row is wanted
        some = old.sparkSession.createDataFrame([(x,) for x in differ], "_leaf int")
        only = lambda d: d.join(F.broadcast(some), _leaf(keys, leaves) == F.col("_leaf"), "left_semi") if differ else d.where(F.lit(False))
        old, new = only(old), only(new)
    a, b = old.select(*keys, F.col(measure).alias("old_value"), F.lit(1).alias("in_old")), new.select(*keys, F.col(measure).alias("new_value"), F.lit(1).alias("in_new"))
    j = a.join(b, list(keys), "full")
    state = F.when(F.col("in_new").isNull(), "only_old").when(F.col("in_old").isNull(), "only_new").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "differs")
    return j.withColumn("state", state).where("state is not null").select(*keys, "state", "old_value", "new_value", (F.col("new_value") - F.col("old_value")).alias("difference"))
