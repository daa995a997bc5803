"""Strips and columns that cannot reach the least score are not scored, and nothing of the others is lost."""

import numpy as np
import pytest
from test_rules import a_catalogue

from reportmill.operators import reports as R


@pytest.mark.parametrize(("strip", "merged"), [(1, 16), (3, 1), (32, 1 << 30)])
def test_kept_pairs_are_those_of_all_strips(spark, monkeypatch, strip, merged):
    monkeypatch.setattr(R, "STRIP", strip)
    monkeypatch.setattr(R, "MERGED", merged)
    monkeypatch.setattr(R, "BLOCK", 4)
    blocks = [bytes(r.block) for r in R.dealt(R.contexts(*a_catalogue(spark))).collect()]
    kept = strips = 0
    for least in (30, R.at_least(80)):
        for i in range(len(blocks)):
            for j in range(i, len(blocks)):
                m = R.Met([blocks[i]] if i == j else [blocks[i], blocks[j]], "B", least, True)
                every, some = np.zeros((2, len(m.ids[0]), len(m.ids[1])))
                for rows, total, keep in m.strips(every=True):
                    every[rows] = total * keep
                    want = sum(m.dimension(k, rows) * w for k, w in R.WEIGHTS["B"].items())
                    assert np.abs(total - want).max() < 1e-6
                for rows, total, keep in m.strips():
                    some[rows] = total * keep
                    strips += 1
                assert (every == some).all()
                strips -= -(-len(m.ids[0]) // strip)
                kept += np.count_nonzero(every)
    assert kept and strips < 0


def test_bands_of_classes_of_several_reports(spark):
    c = R.contexts(*a_catalogue(spark)).cache()
    many = c.unionByName(c.selectExpr("report_id + 1000 AS report_id", *[x for x in c.columns if x != "report_id"]))
    blocks, p = R.dealt(many), R.scored(many).cache()
    got = {r.code: r.n for r in R.bands(blocks, (50, 80)).collect()}
    assert got == {r.code: r.n for r in R.grouped(blocks, R.bands_of((50, 80)), 3).collect()}
    assert sum(r.n for r in R.bands(blocks, (), R.at_least(75)).collect()) == sum(r.pairs for r in p.where("overall >= 75").collect())
