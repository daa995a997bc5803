"""Pairs of reports by their names are made in tasks and stored nowhere."""

import pytest
from test_rules import test_structural_scores as scores

from reportmill.operators import reports as R


@pytest.mark.parametrize("heavy", [100, 2, 0])
def test_scores_in_small_blocks(spark, monkeypatch, heavy):
    monkeypatch.setattr(R, "NAMED_BLOCK", 3)
    monkeypatch.setattr(R, "NAMED_CELLS", 8)
    scores(spark, heavy)


def test_no_table_has_a_row_a_pair(spark, monkeypatch):
    n, stored, store = 120, [], R.store
    rows = [(i, f"D{i % 3}", "x", f"S{i % 2}", "all") for i in range(n)]
    df = spark.createDataFrame(rows, "report_id long, dataset_name string, sql_text string, source_name string, item_name string")
    monkeypatch.setattr(R, "store", lambda x: stored.append(store(x)) or stored[-1])
    got = R.structural(df, heavy=1_000)
    assert {(r.r1, r.r2): r.score for r in got.collect()} == {(i, j): min(100, 70 * (i % 3 == j % 3) + 20 * (i % 2 == j % 2) + 10) for i in range(n) for j in range(i + 1, n)}
    assert stored and max(x.count() for x in stored) <= 4 * n < n * (n - 1) // 2
