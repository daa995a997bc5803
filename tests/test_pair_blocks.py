"""Counts, sums and clusters of report pairs come from the tasks that score them; no pair is stored on the way."""

import pytest
from pyspark.sql import functions as F
from test_rules import a_catalogue

from reportmill.operators import reports as R


@pytest.mark.parametrize("block", [500, 2, 1])
def test_roll_ups_of_blocks_equal_those_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    c = R.contexts(*a_catalogue(spark)).cache()
    blocks, m, p = R.dealt(c), R.class_members(c), R.scored(c).cache()
    rows = lambda d: sorted(map(tuple, d.collect()))
    for k in R.DIMENSIONS:
        want = p.groupBy(F.round(F.col(k) + 1e-9, 4).alias("score")).agg(F.sum("pairs").alias("n"))
        assert rows(R.histogram(blocks, k)) == rows(want)
    assert rows(R.block_partners(R.by_class(blocks), m)) == rows(R.partners(p, m))
    assert rows(R.cells(blocks)) == rows(R.matrix_cells(p))
    for least in (40, 60, 80):
        assert rows(R.block_cluster_table(blocks, m, least).select("size", "similarity")) == rows(R.cluster_table(p, m, least).select("size", "similarity"))
    got = {95 if r.code == 0 else 90 if r.code == 1 else 70: r.n for r in R.grouped(blocks, R.confident, 3).collect()}
    assert got == {r.c: r.n for r in p.groupBy(R.confidence().alias("c")).agg(F.sum("pairs").alias("n")).collect()}
    assert {r.code: r.n for r in R.grouped(blocks, R.bands_of((50, 80)), 3).collect()} == {r.c: r.n for r in p.groupBy(((F.col("overall") >= 50).cast("int") + (F.col("overall") >= 80).cast("int")).alias("c")).agg(F.sum("pairs").alias("n")).collect()}


def test_no_pairs_are_written(spark, monkeypatch):
    """Queries on pairs write classes in blocks, and no table of pairs."""
    from reportmill.plans import reportpairs

    names = []
    once = reportpairs.once
    monkeypatch.setattr(reportpairs, "once", lambda s, d, name, build: names.append(name) or once(s, d, name, build))
    d = "/root/testdata/sf0.001"
    for f in (reportpairs.report_pair_scores, reportpairs.band_counts, reportpairs.file_list, reportpairs.consolidation_clusters, reportpairs.pair_with_queries, reportpairs.all_pair_keys):
        f(spark, d).count()
    assert set(names) <= {"contexts", "blocks"}
