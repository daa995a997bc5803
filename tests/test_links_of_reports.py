"""Corpora are made in many tasks; links of reports are counted a report, without a row a pair."""

import pytest
from pyspark.sql import functions as F
from test_rules import a_catalogue

from reportmill.operators import reports as R
from reportmill.sources.corpus import load


def test_a_corpus_of_one_file_is_made_in_many_tasks(spark, tmp_path):
    n = F.col("id")
    parts = spark.range(200_000).select(n.alias("p_partkey"), F.md5(n.cast("string")).alias("p_name"), F.concat(F.lit("TYPE"), n % 6).alias("p_type"), (n % 50 + 1).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")  # the test's rows are few
    try:
        for name in ("report_query", "report_item"):
            rows = load(spark, str(tmp_path), name)
            assert rows.count() == 200_000 and rows.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("block", [500, 2])
def test_links_of_each_report_are_those_of_the_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    c = R.contexts(*a_catalogue(spark)).cache()
    m, blocks = R.class_members(c).cache(), R.dealt(c)
    for least, analyzed, got in ((30, True, R.linked(blocks, m, ("x", "y"), R.by_weights("A", "B"))), (50, False, R.linked(blocks, m, ("x", "y"), lambda p, rows, total: [p.dimension("source", rows), total], 50, False))):
        p = R.scored(c, least=least, analyzed=analyzed)
        x, y = (R.overall("A"), R.overall("B")) if analyzed else (F.col("source"), F.col("overall"))
        of, want = {r.report_id: (r.class_id, r.copies) for r in m.collect()}, {}
        for r in p.select("r1", "r2", "n1", "n2", x.alias("x"), y.alias("y")).collect():
            for a, k in [(r.r1, r.n1 - 1)] if r.r1 == r.r2 else [(r.r1, r.n2), (r.r2, r.n1)]:
                s = want.setdefault(a, [0, 0.0, 0.0])
                s[:] = s[0] + k, s[1] + k * r.x, s[2] + k * r.y
        rows = got.collect()
        assert {r.report_id for r in rows} == set(of) and any(r.links for r in rows)
        for r in rows:
            k, x, y = want.get(r.class_id, (0, 0, 0))
            assert r.class_id == of[r.report_id][0] and r.links == k
            assert (r.x, r.y) == (None, None) if not k else abs(r.x - x / k) < 1e-4 and abs(r.y - y / k) < 1e-4
