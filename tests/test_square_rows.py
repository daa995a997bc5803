"""The square matrix comes from tasks that make whole rows, with no bound on its width."""

import pytest
from test_rules import a_catalogue

from reportmill.operators import reports as R
from reportmill.plans import reportpairs


@pytest.mark.parametrize(("block", "held"), [(500, 1 << 25), (3, 3)])
def test_rows_equal_the_matrix(spark, monkeypatch, block, held):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "HELD", held)
    c = R.contexts(*a_catalogue(spark)).cache()
    want = {r.report: ",".join(f"{v:.1f}" for v in r.cells) for r in R.matrix(R.scored(c)).collect()}
    some = R.classes(c).where(R.F.col("report_id").isin(list(want)))
    assert want and {r.report: r.cells for r in R.square_rows(R.dealt(some, by_id=True)).collect()} == want


def test_no_width_is_refused(spark, monkeypatch):
    """As a catalogue of more than WIDTH classes was."""
    monkeypatch.setattr(R, "WIDTH", 5)
    monkeypatch.setattr(R.square, "__defaults__", (5,))
    rows = reportpairs.square(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 5 and all(len(r.cells.split(",")) == len(rows) for r in rows)
