"""Best pairs of queries, merged scorings and keys of pairs come from the tasks that have two blocks; no pair is joined or shuffled."""

import duckdb
import pytest

from reportmill.operators import reports as R
from reportmill.plans import catalogue, registry


@pytest.mark.parametrize("name", ["best_query_pair_per_report_pair", "merge_scorings", "all_pair_keys"])
@pytest.mark.parametrize("block", [4_000, 9])
def test_rows_in_blocks_of_any_size(spark, monkeypatch, name, block):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "STRIP", 5)
    monkeypatch.setattr(registry, "_ONCE", {})
    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    got, want = catalogue.queries()[name](spark, "/root/testdata/sf0.001"), con.sql(catalogue.oracle_sql()[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_links_of_lists_of_any_length(spark):
    """Classes with no, one or several signatures, some without links, and ties of which the smallest queries win."""
    held = {1: [(10, 5), (11, 6)], 2: [(20, 6)], 3: [(30, 7), (31, 5), (32, 6)], 4: [], 5: [(50, 8)]}
    links = {(5, 6): 0.9, (6, 6): 0.95, (5, 7): 0.95, (7, 7): 0.8}
    links |= {(b, a): v for (a, b), v in links.items()}
    c = spark.createDataFrame([(i, 2 if i == 2 else 1, [s for _, s in x], [q for q, _ in x]) for i, x in held.items()], "report_id long, n long, sigs array<long>, queries array<long>")
    c = c.selectExpr("*", *[f"CAST(array() AS array<string>) AS {x}" for x in R.LISTS], *[f"'{x}' AS {x}" for x in R.SINGLE])
    blocks = R.with_links(R.dealt(c, by_id=True), spark.createDataFrame([(*k, v) for k, v in links.items()], "s1 long, s2 long, final double"))
    want = {}
    for i in held:
        for j in held:
            if i < j or i == j == 2:
                found = [(-links[s, t], p, q) for p, s in held[i] for q, t in held[j] if (s, t) in links]
                if found:
                    want[i, j] = min(found)
    assert {(r.r1, r.r2): (-r.final, r.q1, r.q2) for r in R.best_pairs(blocks).collect()} == want
