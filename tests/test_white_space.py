"""Report files hold what they were given, white space at the ends included."""

from reportmill.sources import reportxml as X


def test_white_space_at_the_ends_is_written(spark, tmp_path):
    texts = {1: "<Report> cut off ", 2: "  <b/>", 3: "x"}
    X.write_files(spark.createDataFrame(list(texts.items()), "report_id long, content string"), f"{tmp_path}/files")
    assert {r.content for r in X.scan_files(spark, f"{tmp_path}/files").collect()} == {f"{t}\n" for t in texts.values()}
