"""Sharding over fixed virtual slots.

Records are hashed into SLOTS virtual slots; the bytes of every slot are summed (map-side combined); and a versioned
slot-to-shard map, a bounded table of SLOTS rows kept in a folder, says where a slot lives. Version 1 deals the slots out in
turn. Every later version is an edit of the one before: shards above the mean release slots, the heaviest first, as long as
they stay at or above it, and these go to the lightest shards, or to a new shard alone. So only the records of moved slots
travel.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.operators.shared import checkpoint_dir, cut

SLOTS = 4096
SHARDS = 24
#: Copies of a row that travel as one range of their numbers.
RANGE = 1000
#: A map is edited only where that makes its heaviest shard lighter by more than this share.
SLACK = 0.001


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), one row per row of docs.

    The slot is a hash of id, text and the number of the copy: rows without an id, or that share one, spread as well, and
    so do rows that are repeated, which are counted first and dealt out again. A null text has no bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    counts = rows.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE).cast("long"))))
    copies = ranges.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + RANGE) - 1)))
    return copies.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "hash", "copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): at most SLOTS rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, shard): the slots dealt out in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def edited(current: DataFrame, loads: DataFrame, shards: int, into: int = 0) -> DataFrame:
    """(virtual_slot, shard): current with slots moved to even out the bytes of so many shards.

    Slots move only into shards numbered into and above: 0 to rebalance, the number of a new shard to fill that one alone.
    """
    weighed = current.select("virtual_slot", "shard").join(loads, "virtual_slot", "left").select("virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    state = weighed.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("slots"))
    add = lambda loads, k, v: F.transform(loads, lambda x, i: F.when(i == k, x + v).otherwise(x))
    sums = F.aggregate("slots", F.array_repeat(F.lit(0).cast("long"), shards), lambda a, s: add(a, s["shard"], s["bytes"]))
    state = state.select("slots", sums.alias("loads")).withColumn("mean", F.aggregate("loads", F.lit(0).cast("long"), lambda a, x: a + x) / shards)

    def release(s: Column, slot: Column) -> Column:
        go = (slot["bytes"] > 0) & (F.get(s["loads"], slot["shard"]) - slot["bytes"] >= s["mean"])
        after = F.struct(slot["bytes"].alias("bytes"), slot["virtual_slot"].alias("virtual_slot"), F.when(~go, slot["shard"]).alias("shard"))
        return F.struct(add(s["loads"], slot["shard"], F.when(go, -slot["bytes"]).otherwise(0)).alias("loads"), F.concat(s["to"], F.array(after)).alias("to"), s["mean"].alias("mean"))

    def place(s: Column, slot: Column) -> Column:
        open_ = F.slice(s["loads"], into + 1, shards - into)
        lightest = F.array_position(open_, F.array_min(open_)).cast("int") - 1 + into
        to = F.coalesce(slot["shard"], lightest)
        return F.struct(add(s["loads"], to, F.when(slot["shard"].isNull(), slot["bytes"]).otherwise(0)).alias("loads"), F.concat(s["to"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("to"))

    start = F.struct(F.col("loads"), F.array().cast("array<struct<bytes:bigint,virtual_slot:int,shard:int>>").alias("to"), F.col("mean"))
    state = state.select("slots", F.aggregate("slots", start, release).alias("s")).select(F.col("s.loads").alias("loads"), F.col("s.to").alias("slots"))
    start = F.struct(F.col("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("to"))
    return state.select(F.inline(F.aggregate("slots", start, place, lambda s: s["to"])))


def keep_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Stores a version at path, in a folder of its own; keeping the same version again replaces it."""
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, virtual_slot, shard): this version, or the latest."""
    every = spark.read.schema("virtual_slot int, shard int, version int").option("basePath", path).parquet(path)
    wanted = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def rebalance(spark: SparkSession, path: str, loads: DataFrame, shards: int, into: int = 0) -> DataFrame:
    """Edits the latest map at path for these loads and stores it as the next version; returns the latest.

    An edit that hardly makes the heaviest shard lighter is not stored. Shards that a map does not know are new and empty.
    """
    current = stored_map(spark, path)
    after = cut(edited(current, loads, shards, into))
    weigh = lambda m: m.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    if not into and weigh(after) >= weigh(current) * (1 - SLACK):
        return current
    version = current.agg(F.max("version")).first()[0] + 1
    keep_map(after, path, version)
    return stored_map(spark, path, version)


def assign(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """rows with shard, map version and slot: the row's place in its shard, gapless from 0.

    The place is the rows of the shard's earlier virtual slots plus the place inside the own virtual slot, so no task sees
    more than one virtual slot. The map that is broadcast has SLOTS rows at most.
    """
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))
    places = slot_map.join(loads, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("inside", inside).join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("before") + F.col("inside") - 1)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version): one row per row of docs.

    Law `bytes`: the shards' sizes are near equal. The map is the latest in the folder maps, edited for these documents; in
    a new folder it starts with version 1. Without maps the folder is one in the session's shared folder.
    Rows without id or text, and repeated rows, are placed like any other; rows that are equal in id, size and text may swap
    places. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = maps or f"{checkpoint_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        keep_map(first_map(spark, shards, slots), path, 1)
    rows = cut(slotted(docs, id_col, text_col, slots))
    loads = cut(slot_loads(rows))
    placed = assign(rows, rebalance(spark, path, loads, shards), loads)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
