"""Reports that share only names which many have are pairs like any others."""

import duckdb

from reportmill.operators import reports
from reportmill.plans import catalogue


def test_names_of_many_reports_make_pairs(spark):
    n = 240
    rows = [(i, f"D{i}", "x", "S" if i % 2 else f"S{i}", "all" if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "report_id long, dataset_name string, sql_text string, source_name string, item_name string")
    got = {(r.r1, r.r2): r.score for r in reports.structural_pairs(df).collect()}
    score = {(i, j): 20 * (i % 2 and j % 2) + 10 * bool(i % 3 and j % 3) for i in range(n) for j in range(i + 1, n)}
    assert got == {k: v for k, v in score.items() if v}


def test_a_row_a_pair_of_reports(spark, tmp_path):
    """120 parts of a size make names that more than 100 reports and a twentieth of all have."""
    parts = spark.range(500).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "concat('TYPE', id % 6) AS p_type", "CAST(7 AS INT) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got, want = catalogue.queries()["report_pair_structural"](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()["report_pair_structural"])
    assert got.columns == want.columns == ["r1", "r2", "score"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) == len({r[:2] for r in rows})
