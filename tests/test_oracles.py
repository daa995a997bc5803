"""Queries against their SQL at the smallest scale."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from reportmill.plans import catalogue

#: Of the heavier families a few stand for all; the rest run one by one through tools/compare.py.
HEAVY = {
    "reportmill.plans.reportpairs": {"report_context", "report_pair_scores", "merge_scorings", "consolidation_clusters", "savings_estimate", "report_pair_structural"},
    "reportmill.plans.querypairs": {"query_pair_final", "query_pair_features", "stage_funnel", "structure_vector"},
    "reportmill.plans.ingest": {"scan_dataset_fields", "scan_report_items", "scan_chart_series", "quarantine_bad_reports", "sink_by_report"},
}
FAMILIES: dict[str, list[str]] = {}
for _name, _query in catalogue.queries().items():
    if _name in catalogue.oracle_sql() and _name in HEAVY.get(_query.__module__, {_name}):
        FAMILIES.setdefault(_query.__module__, []).append(_name)


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_queries_match_their_sql(spark, family):
    import importlib.util

    spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[1] / "tools/compare.py")
    compare = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(compare)
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in FAMILIES[family]:
        df = catalogue.queries()[name](spark, folder)
        res = con.sql(catalogue.oracle_sql()[name])
        assert compare.rows(df.columns, [tuple(r) for r in df.collect()]) == compare.rows(res.columns, res.fetchall()), name


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'report_product_sales' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_dialects.py"], cwd=copy, check=True, env=env, timeout=300)
    assert not any("reportmill.llm" in p.read_text() for p in (copy / "reportmill").rglob("*.py"))
