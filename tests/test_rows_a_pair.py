"""Queries on pairs of reports give a row a pair, as their SQL does."""

import pytest
from pyspark.sql import functions as F
from test_rules import a_catalogue

from reportmill.operators import reports as R
from reportmill.plans import catalogue


@pytest.mark.parametrize("block", [500, 2])
def test_values_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    c = R.contexts(*a_catalogue(spark)).cache()
    blocks, rows = R.dealt(c), lambda d: sorted((r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in d.collect())
    got = rows(R.valued(blocks, ("x", "y"), R.by_weights("A", "B")))
    assert got and got == rows(R.scored(c).select("r1", "r2", R.overall("A"), R.overall("B")))
    got = rows(R.valued(blocks, ("x", "y"), lambda m, at, total: [m.dimension("source", at), total], 50, False))
    assert got and got == rows(R.scored(c, least=50, analyzed=False).select("r1", "r2", "source", "overall"))


@pytest.mark.parametrize("name", ["report_pair_overall", "dim_data_source_plain"])
def test_a_row_a_pair(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    df, want = catalogue.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(catalogue.oracle_sql()[name])
    assert df.columns == want.columns and df.columns[:2] == ["r1", "r2"]
    near = lambda rows: [(a, b, round(x, 4), round(y, 4)) for a, b, x, y in sorted(rows)]
    got = near(map(tuple, df.select("r1", "r2", *(F.col(k) for k in df.columns[2:])).collect()))
    assert got and got == near(want.fetchall())
