"""State stores of a stream are bound by the cores, not by the parts of the session's shuffles."""

import os

from pyspark.sql import functions as F

from reportmill.operators import pairs
from reportmill.operators.shared import folder
from reportmill.plans import querylog, streams

SF = "/root/testdata/sf0.001"


def test_stores_do_not_grow_with_shuffles_and_a_restart_keeps_them(spark):
    key = "spark.sql.shuffle.partitions"
    sigs = pairs.signatures(querylog.featured(spark, SF)).orderBy("sig").limit(12).cache()
    rows = sigs.select("sig", F.array_distinct("domains").alias("domains"), pairs.reach(F.col("domains")).alias("reach"))
    want = {(r.sig1, r.sig2): r.final for r in pairs.scored(sigs).where("final >= 0.5").select(F.col("a.sig").alias("sig1"), F.col("b.sig").alias("sig2"), F.round("final", 6).alias("final")).collect()}
    half = sorted(r.sig for r in sigs.select("sig").collect())[6]
    before = spark.conf.get(key)
    try:
        for first, then, stores in (("40", "40", 2 * spark.sparkContext.defaultParallelism), ("3", "40", 3)):
            inbox, root = folder(spark, "inbox"), folder(spark, "run")
            for parts, some in ((first, F.col("sig") < half), (then, F.col("sig") >= half)):
                spark.conf.set(key, parts)
                rows.where(some).coalesce(1).write.mode("append").parquet(inbox)
                met = streams.matched(sigs, inbox, root)
                assert spark.conf.get(key) == parts
            assert {(r.sig1, r.sig2): r.final for r in met.collect()} == want
            assert len([p for p in os.listdir(f"{root.removeprefix('file:')}/state/state/0") if p.isdigit()]) == stores
    finally:
        spark.conf.set(key, before)
