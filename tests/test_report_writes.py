"""Report files are written without a writer of Spark's for each."""

import os

from pyspark.sql import functions as F

from reportmill.sources import reportxml as X


def test_report_files_are_a_row_each(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(30).select((F.col("id") - 3).alias("report_id"), F.concat(F.lit(" <é> \n"), F.col("id").cast("string"), F.lit("  ")).alias("content"))
    X.write_files(rows, folder)
    back = X.scan_files(spark, folder).select(F.regexp_extract("path", r"report_id=(-?\d+)/", 1).cast("long").alias("report_id"), "content").collect()
    assert {(r.report_id, r.content) for r in back} == {(r.report_id, r.content + "\n") for r in rows.collect()} and len(back) == 30
    assert not [f for _, _, files in os.walk(folder) for f in files if f.endswith(".crc") and f.startswith(".part")]  # left by Spark's own writer
