"""Upkeep of a table of stored results: entries with a key, tags, times and a size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.operators.shared import summed


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key, by order. A struct maximum, so rows are reduced before they are shuffled."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in df.columns if c != key))


def expire(df: DataFrame, at: str, now: Column, hours: int = 24) -> DataFrame:
    """Entries that are not past their time: at plus hours is now or later."""
    return df.where(F.col(at) + F.expr(f"INTERVAL {hours} HOURS") >= now)


def keep_recent(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows by order."""
    return df.orderBy(*order).limit(n)


def lookup(keys: DataFrame, store: DataFrame, key: str, at: str, now: Column, hours: int = 24) -> DataFrame:
    """keys with hit: whether a stored row is there and still valid."""
    valid = expire(store, at, now, hours).select(F.col(key).alias("_k")).distinct()
    return keys.join(valid, F.col(key) == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


def within_budget(df: DataFrame, size: str, at: str, key: str, limit: float, share: float = 0.8) -> DataFrame:
    """If all sizes exceed limit, the most recently read entries that fit into share of it; else all. A null size counts as nothing.

    The running sum goes by ranges of time, so a day on which most entries were read is several tasks.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        return df
    run = summed(df.withColumn("_size", F.coalesce(F.col(size), F.lit(0))), "_run", "_size", F.desc(at), F.col(key))
    return run.where(F.col("_run") <= limit * share).select(*df.columns)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def without_tags(df: DataFrame, tags: str, gone: Sequence[str]) -> DataFrame:
    """Rows that carry none of the tags, compared whole."""
    return df.where(~F.arrays_overlap(F.col(tags), F.array(*map(F.lit, gone))))


def touched(log: DataFrame, key: str, at: str) -> DataFrame:
    """Last reading and number of readings of each key."""
    return log.groupBy(key).agg(F.max(at).alias("last_read"), F.count(F.lit(1)).alias("reads"))


def access_stats(log: DataFrame, key: str, order: list[str], at: Column, size: str, memory: int, disk: int) -> DataFrame:
    """One row on a log of accesses: entries, hits in memory and on disk (by the time since the key's last access), misses, hit rate, size and mean."""
    gap = F.col("at") - F.lag("at").over(W.partitionBy(key).orderBy(*order))
    t = log.withColumn("at", at).withColumn("gap", gap)
    n, near, far = F.count(F.lit(1)), F.count_if(F.col("gap") <= memory), F.count_if((F.col("gap") > memory) & (F.col("gap") <= disk))
    return t.agg(F.countDistinct(key).alias("entries"), near.alias("memory_hits"), far.alias("disk_hits"), (n - near - far).alias("misses"), F.round((near + far) / n, 6).alias("hit_rate"), F.round(F.sum(size), 2).alias("size"), F.round(F.avg(size), 6).alias("mean_access"))
