"""Keyed streams across restarts, running sums over hot days, reconciliation by digests, and sketches that unite."""

import os
import random

from pyspark.sql import functions as F

from reportmill.operators import pairs, store, validation
from reportmill.operators.shared import folder, numbered, summed
from reportmill.plans import querylog, streams
from reportmill.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_a_run_cut_in_two_meets_what_one_run_meets(spark):
    sigs = pairs.signatures(querylog.featured(spark, SF)).orderBy("sig").limit(40).cache()
    rows = sigs.select("sig", F.array_distinct("domains").alias("domains"), pairs.reach(F.col("domains")).alias("reach"))
    ids = [r.sig for r in rows.select("sig").orderBy("sig").collect()]
    inbox, root = folder(spark, "inbox"), folder(spark, "run")
    part = lambda k: rows.where(F.col("sig").isin(ids[k::3])).coalesce(1).write.mode("append").parquet(inbox)
    part(2)
    first = streams.matched(sigs, inbox, root).collect()
    part(0)
    part(1)
    got = {(r.sig1, r.sig2): r.final for r in streams.matched(sigs, inbox, root).collect()}
    want = {(r.sig1, r.sig2): r.final for r in pairs.scored(sigs).where("final >= 0.5").select(F.col("a.sig").alias("sig1"), F.col("b.sig").alias("sig2"), F.round("final", 6).alias("final")).collect()}
    assert got == want and 0 < len(first) < len(want)
    with jobs.keyed_state(spark):
        again = jobs.run_to_table(jobs.meetings(jobs.file_stream(spark, inbox, "*.parquet")), root=root)
    assert again.count() == again.distinct().count()


def test_size_budget_of_one_hot_day(spark):
    random.seed(1)
    rows = [(i, f"2024-01-{1 + (i % 50 == 0):02d} {i % 24:02d}:{i % 60:02d}:{i % 59:02d}", float(random.randint(0, 9)) if i % 17 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t string, s double").withColumn("t", F.to_timestamp("t")).repartition(5)
    run, want = 0.0, set()
    for k, _, s in sorted(rows, key=lambda r: r[0]) and sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: r[1], reverse=True):
        run += s or 0.0
        if run <= 800:
            want.add(k)
    assert {r.k for r in store.within_budget(df, "s", "t", "k", 1000.0).collect()} == want and len(want) < 600
    assert store.within_budget(df, "s", "t", "k", 1e9).count() == 600 and store.within_budget(df.limit(0), "s", "t", "k", 1.0).count() == 0


def test_running_sums_and_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("long").alias("v")).repartition(6)
    got = {r.id: (r.run, r.place) for r in numbered(summed(df, "run", "v", F.desc("id")), "place", "id").collect()}
    run = 0
    for i in reversed(range(1000)):
        run += i % 7
        assert got[i] == (run, i + 1)


def reconciled(old, new):
    out = set()
    for k in old.keys() | new.keys():
        if k not in new:
            out.add((k, "only_old"))
        elif k not in old:
            out.add((k, "only_new"))
        elif old[k] != new[k]:
            out.add((k, "differs"))
    return out


def test_reconciliation(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "k long, v double").repartition(4)
    old = {i: float(i % 13) if i % 11 else None for i in range(500)}
    for new in (old, {k: v for k, v in old.items() if k != 77}, old | {600: 1.0}, old | {5: None, 11: 2.0}, {}, {k: (v or 0.0) + 1.0 for k, v in old.items()}):
        for leaves in (4, 65_536):
            got = validation.reconcile(make(old), make(new) if new else make(old).limit(0), ["k"], "v", leaves).collect()
            assert {(r.k, r.state) for r in got} == reconciled(old, new)


def test_equal_tables_are_not_shuffled(spark):
    rows = spark.range(2000).withColumn("v", F.col("id") * 0.5)
    plan = validation.reconcile(rows, rows, ["id"], "v")
    assert plan.count() == 0 and validation.unequal_leaves(rows, rows, ["id"], "v").count() == 0
    changed = rows.withColumn("v", F.when(F.col("id") == 7, -1.0).otherwise(F.col("v")))
    assert validation.unequal_leaves(rows, changed, ["id"], "v").count() == 1
    assert "LocalTableScan <empty>" in plan._jdf.queryExecution().optimizedPlan().toString() or "LocalRelation <empty>" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_sketches_unite(spark):
    n = 40_000
    rows = spark.range(n).select((F.col("id") % 9).alias("day"), F.array(F.concat(F.lit("t"), F.col("id") % 5000)).alias("tables"), F.array(F.concat(F.lit("c"), "id"), F.lit("all")).alias("columns"), F.md5((F.col("id") % 300).cast("string")).alias("semantic_hash"))
    kept = querylog.sketches(rows, "day").cache()
    whole = querylog.united(kept).first()
    for got, want in ((whole.tables, 5000), (whole.columns, n + 1), (whole.signatures, 300)):
        assert abs(got - want) <= 3 * 1.04 / 64 * want
    apart = querylog.united(kept.where("day < 4").unionByName(kept.where("day >= 4")))
    assert apart.first() == whole and os.path.exists(SF)
