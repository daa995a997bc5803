"""Datasets find their source in their own report; reports are shredded once and not joined with themselves."""

from reportmill.plans import catalogue
from reportmill.sources import reportxml as X


def test_sources_of_datasets(spark):
    source = lambda n, p: f'<DataSource Name="{n}"><ConnectionProperties><DataProvider>{p}</DataProvider><ConnectString>Initial Catalog={p}1</ConnectString></ConnectionProperties></DataSource>'
    dataset = lambda n, s: f'<DataSet Name="{n}"><Query>{f"<DataSourceName>{s}</DataSourceName>" if s else ""}<CommandText>x</CommandText></Query></DataSet>'
    text = lambda sources, sets: f'<Report xmlns="http://schemas.microsoft.com/sqlserver/reporting/2008/01/reportdefinition">{f"<DataSources>{sources}</DataSources>" if sources else ""}<DataSets>{sets}</DataSets></Report>'
    rows = [(1, text(source("A", "SQL") + source("B", "ODBC"), dataset("x", "A") + dataset("y", "B") + dataset("z", "C") + dataset("n", None))), (2, text("", dataset("x", "A"))), (3, text(source("A", "ORACLE"), dataset("x", "A"))), (4, "<Report>")]
    df = X.shred(spark.createDataFrame(rows, "report_id long, content string"))
    got = sorted(tuple(r) for r in X.datasets_with_sources(df).na.fill("-").collect())
    assert got == [(1, "n", "-", "-"), (1, "x", "SQL", "Initial Catalog=SQL1"), (1, "y", "ODBC", "Initial Catalog=ODBC1"), (1, "z", "-", "-"), (2, "x", "-", "-"), (3, "x", "ORACLE", "Initial Catalog=ORACLE1")]
    left, right = X.datasets(df), X.data_sources(df).selectExpr("report_id", "name AS source", "provider", "connect_string")
    assert got == sorted(tuple(r) for r in left.join(right, ["report_id", "source"], "left").select("report_id", "name", "provider", "connect_string").na.fill("-").collect())


def test_reports_are_not_joined_with_themselves(spark):
    plan = lambda name: catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("dataset_with_source").count("Join") == plan("scan_datasets").count("Join")
