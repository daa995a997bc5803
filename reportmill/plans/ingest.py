"""Ingest of report definitions: shredding, scans of the parts, quarantine and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import rules
from reportmill.operators import reports as R
from reportmill.operators.shared import folder as shared_folder
from reportmill.plans import reportpairs
from reportmill.plans.registry import query, table
from reportmill.plans.rules import OUTPUT, C, I, P, Q
from reportmill.sources import reportfiles
from reportmill.sources import reportxml as X
from reportmill.sources.corpus import oracle

SOUND = "report_id % 50 <> 49"


def shredded(spark: SparkSession, d: str) -> DataFrame:
    return X.shred(X.derived(spark, d))


@query(f"SELECT report_id, schema_year AS year, provider FROM {C} WHERE {SOUND}")
def shred_report_xml(spark: SparkSession, d: str) -> DataFrame:
    return X.sound(shredded(spark, d)).select("report_id", "year", F.col("r.DataSources.DataSource")[0]["ConnectionProperties"]["DataProvider"].alias("provider"))


@query(f"SELECT report_id FROM {C} WHERE NOT ({SOUND})")
def quarantine_bad_reports(spark: SparkSession, d: str) -> DataFrame:
    return X.broken(shredded(spark, d)).select("report_id")


@query(f"SELECT report_id, 'Main' AS name, provider, connect_string FROM {C} WHERE {SOUND}")
def scan_data_sources(spark: SparkSession, d: str) -> DataFrame:
    return X.data_sources(shredded(spark, d)).select("report_id", "name", "provider", "connect_string")


@query(f"SELECT report_id, 'DS' || query_id AS name, 'Main' AS source, trim(sql_text) AS sql_text, 'Text' AS command_type FROM {Q} WHERE {SOUND}")
def scan_datasets(spark: SparkSession, d: str) -> DataFrame:
    return X.datasets(shredded(spark, d)).withColumn("sql_text", F.trim("sql_text"))


@query(f"SELECT report_id, 'DS' || query_id AS dataset, '@p' AS name, '=Parameters!p.Value' AS value FROM {Q} WHERE {SOUND} AND query_id % 3 = 0")
def scan_query_params(spark: SparkSession, d: str) -> DataFrame:
    return X.query_parameters(shredded(spark, d))


@query(f"SELECT report_id, 'DS' || query_id AS dataset, 'A' AS name, 'A' AS data_field, 'INT' AS data_type, false AS is_calculated, NULL AS expression FROM {Q} WHERE {SOUND} UNION ALL SELECT report_id, 'DS' || query_id, 'B', NULL, NULL, true, '=Fields!A.Value * 2' FROM {Q} WHERE {SOUND} AND query_id % 5 = 0")
def scan_dataset_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.fields(shredded(spark, d))


@query(f"SELECT report_id, 'DS' || query_id AS dataset, '=Fields!A.Value' AS expression, 'Equal' AS operator, query_id || ',x' AS filter_values FROM {Q} WHERE {SOUND} AND query_id % 2 = 0")
def scan_dataset_filters(spark: SparkSession, d: str) -> DataFrame:
    return X.filters(shredded(spark, d)).select("report_id", "dataset", "expression", "operator", F.concat_ws(",", "values").alias("filter_values"))


@query(f"SELECT report_id, param_name AS name, data_type, data_type = 'String' AS blank, false AS multi, CASE WHEN data_type = 'String' THEN '' ELSE '1,2' END AS defaults FROM {P} WHERE {SOUND}")
def scan_report_params(spark: SparkSession, d: str) -> DataFrame:
    return X.parameters(shredded(spark, d)).withColumn("defaults", F.concat_ws(",", "defaults"))


@query(f"SELECT report_id, item_name, item_type FROM {I} WHERE {SOUND}")
def scan_report_items(spark: SparkSession, d: str) -> DataFrame:
    return X.items(shredded(spark, d))


@query(f"SELECT report_id, item_name, item_name AS column_name, expression FROM {I} WHERE {SOUND} AND item_type = 'Table'")
def scan_table_columns(spark: SparkSession, d: str) -> DataFrame:
    return X.table_columns(shredded(spark, d))


@query(f"SELECT report_id, item_name, kind, CASE kind WHEN 'row' THEN 'g_' ELSE 'c_' END || item_name AS group_name, expression AS expressions FROM {oracle('report_group')} WHERE {SOUND} AND kind <> 'category'")
def scan_table_groups(spark: SparkSession, d: str) -> DataFrame:
    """Row and column groups of tables, however deep they are nested."""
    return X.table_groups(shredded(spark, d))


@query(f"SELECT report_id, layout FROM {OUTPUT} WHERE {SOUND}")
def scan_report_layout(spark: SparkSession, d: str) -> DataFrame:
    """The layout of a report by its definition: a chart, else a table with a column group, else a table."""
    return X.layouts(shredded(spark, d))


@query(f"SELECT report_id, item_name, '=Fields!A.Value' AS categories, 's' AS series, CASE WHEN length(item_name) % 2 = 0 THEN 'Line' ELSE 'Column' END AS kind, expression FROM {I} WHERE {SOUND} AND item_type = 'Chart'")
def scan_chart_series(spark: SparkSession, d: str) -> DataFrame:
    return X.chart_series(shredded(spark, d))


@query(f"SELECT report_id, 'DS' || query_id AS name, trim(sql_text) AS sql_text, CASE query_id % 6 WHEN 0 THEN '@StartDate,@StartDate2' WHEN 3 THEN '$1' ELSE '' END AS parameters FROM {Q} WHERE {SOUND}")
def scan_report_queries(spark: SparkSession, d: str) -> DataFrame:
    return X.queries(shredded(spark, d))


@query(f"SELECT q.report_id, 'DS' || q.query_id AS name, c.provider, 'DB' || q.report_id % 7 AS database FROM {Q} q JOIN {C} c USING (report_id) WHERE {SOUND}")
def dataset_with_source(spark: SparkSession, d: str) -> DataFrame:
    return X.datasets_with_sources(shredded(spark, d)).select("report_id", "name", "provider", rules.database_name(F.col("connect_string")).alias("database"))


@query(f"SELECT report_id, 'report_id=' || report_id AS folder, true AS dated, true AS whole, CASE WHEN {SOUND} THEN schema_year END AS year FROM {C}")
def scan_report_files(spark: SparkSession, d: str) -> DataFrame:
    """Definitions are written as .rdl files, one folder each, and scanned back by the data source with path, time, length and content."""
    folder = shared_folder(spark, "files")
    texts = X.derived(spark, d)
    X.write_files(texts, folder)
    files = X.scan_files(spark, folder).withColumn("report_id", F.regexp_extract("path", r"report_id=(\d+)", 1).cast("long"))
    shredded = X.shred(files).join(texts.select("report_id", F.octet_length("content").alias("bytes")), "report_id")
    return shredded.select("report_id", F.regexp_extract("path", r"(report_id=\d+)/[^/]*\.rdl$", 1).alias("folder"), F.col("modificationTime").isNotNull().alias("dated"), (F.col("length") == F.col("bytes") + 1).alias("whole"), F.when(F.col("r").isNotNull() & F.col("r._corrupt").isNull(), F.col("year")).alias("year"))


@query(f"SELECT r1, r2, pairs, overall FROM {reportpairs.PAIRS}")
def sink_pairs_json(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "json")
    pairs = reportpairs.pairs(spark, d, *R.DIMENSIONS)
    pairs.select("r1", "r2", "pairs", "overall", F.struct(*R.DIMENSIONS).alias("dimensions")).write.option("compression", "gzip").json(folder)
    return spark.read.schema("r1 long, r2 long, pairs long, overall double").json(folder)


@query(f"SELECT report_name, item_name, item_type, expression FROM {I} JOIN {C} USING (report_id)")
def sink_by_report(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "reports")
    from reportmill.sources.corpus import load

    rows = load(spark, d, "report_item").join(load(spark, d, "report_catalog").select("report_id", "report_name"), "report_id").select("report_name", "item_name", "item_type", "expression")
    reportfiles.register(spark)
    rows.repartition("report_name").sortWithinPartitions("report_name").write.format("report_folders").option("by", "report_name").mode("append").save(folder)
    return spark.read.format("report_folders").option("by", "report_name").schema("report_name string, item_name string, item_type string, expression string").load(folder)


@query("SELECT vec_id, label, 'given' AS provider, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def sink_embeddings(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "vectors")
    table(spark, d, "embeddings").withColumn("provider", F.lit("given")).write.partitionBy("label").parquet(folder)
    back = spark.read.parquet(folder)
    return back.select("vec_id", "label", "provider", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(reportpairs.SQUARE)
def sink_matrix_csv(spark: SparkSession, d: str) -> DataFrame:
    """The square matrix as comma-separated lines: a report, then its cells in order of the reports' ids."""
    folder = shared_folder(spark, "csv")
    reportpairs.square(spark, d).select(F.concat_ws(",", F.col("report").cast("string"), "cells").alias("line")).write.option("compression", "gzip").text(folder)
    line = spark.read.text(folder)
    return line.select(F.substring_index("value", ",", 1).cast("long").alias("report"), F.expr("substr(value, instr(value, ',') + 1)").alias("cells"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def sink_store_metadata(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "meta")
    reportfiles.register(spark)
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.format("report_folders").option("kind", "json").mode("append").save(folder)
    return spark.read.schema("event_id long, user_id long, event_type string, value double").json(folder)


@query("SELECT regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]*)', 1) AS kind, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def artifact_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the first part of their path, which stands for the extension."""
    kind = F.regexp_extract("url", "^[a-z]+://[^/?#]+/([a-z]*)", 1)
    return table(spark, d, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]*)', 1) AS kind, strlen(html) AS bytes FROM pages ORDER BY kind, url")
def artifact_listing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+/([a-z]*)", 1).alias("kind"), F.octet_length("html").cast("long").alias("bytes"), "url")
    return p.orderBy("kind", "url").drop("url")
