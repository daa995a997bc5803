"""Pairs of names are made distinct in the tasks that score them."""

import duckdb
import pytest

from reportmill.operators import reports as R
from reportmill.plans import catalogue


@pytest.mark.parametrize("named", [1_000, 4])
def test_rows_in_slots_of_any_size(spark, monkeypatch, named):
    monkeypatch.setattr(R, "NAMED", named)
    monkeypatch.setattr(R, "STRIP", 3)
    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    got, want = catalogue.queries()["dedupe_pairs"](spark, "/root/testdata/sf0.001"), con.sql(catalogue.oracle_sql()["dedupe_pairs"])
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and len(rows) == len({r[:2] for r in rows})
    plan = got._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Join" not in plan
