"""Streaming queries, run over the event log and the catalogue until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators import pairs as QP
from reportmill.operators.shared import folder, store
from reportmill.plans.querylog import featured
from reportmill.plans.querypairs import SCORED
from reportmill.plans.registry import query, table
from reportmill.plans.rules import C, Q
from reportmill.sources import reportxml as X
from reportmill.streaming import jobs


def events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.file_stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def written(df: DataFrame, files: int = 4) -> str:
    """df as the arriving files of a stream."""
    path = folder(df.sparkSession, "arriving")
    df.repartition(files).write.parquet(path)
    return path


@query(f"SELECT report_id, schema_year AS year, (SELECT count(*) FROM {Q} q WHERE q.report_id = c.report_id) AS datasets, 1::BIGINT AS times FROM {C} c WHERE report_id % 50 <> 49")
def stream_ingest_reports(spark: SparkSession, d: str) -> DataFrame:
    """Report files arrive, every tenth a second time under another name; each content is shredded once, and the sound ones stay."""
    path, texts = folder(spark, "arriving"), X.derived(spark, d)
    again = texts.where("report_id % 10 = 0").withColumn("report_id", -1 - F.col("report_id"))
    X.write_files(texts.unionByName(again), path)
    files = X.stream_files(spark, path).withColumn("h", F.md5("content"))
    once = X.sound(X.shred(jobs.distinct_content(files, "h", "modificationTime")))
    rows = jobs.run_to_table(once.select("year", F.col("r.DataSets.DataSet._Name").alias("names")))
    report = F.floor(F.substring(F.col("names")[0], 3, 20).cast("long") / 4)
    return rows.groupBy(report.alias("report_id"), "year").agg(F.max(F.size("names")).cast("long").alias("datasets"), F.count(F.lit(1)).alias("times"))


@query(f"SELECT a.sig AS sig1, b.sig AS sig2, round(final, 6) AS final FROM {SCORED} WHERE final >= 0.5")
def stream_match_new(spark: SparkSession, d: str) -> DataFrame:
    """Signatures arrive file by file; each is scored against all that arrived before it, which keyed state holds by domain."""
    sigs = store(QP.signatures(featured(spark, d)))
    arriving = written(sigs.select("sig", F.array_distinct("domains").alias("domains"), QP.reach(F.col("domains")).alias("reach")))
    return matched(sigs, arriving)


def matched(sigs: DataFrame, arriving: str, root: str | None = None) -> DataFrame:
    """(sig1, sig2, final) of what has met so far; with the same root a run goes on where the last one was."""
    spark = sigs.sparkSession
    with jobs.keyed_state(spark):
        met = jobs.run_to_table(jobs.meetings(jobs.file_stream(spark, arriving, "*.parquet", at_once=1)), root=root)
    near = QP.scored_pairs(sigs, met.select(F.least("new_sig", "old_sig").alias("sig1"), F.greatest("new_sig", "old_sig").alias("sig2")), "sig1", "sig2")
    return near.where("final >= 0.5").select("sig1", "sig2", F.round("final", 6).alias("final"))


@query("""WITH e AS (SELECT *, event_id % 50 = 0 AS late FROM events), m AS (SELECT max(ts) FILTER (NOT late AND epoch_us(ts) <= (SELECT CAST(floor(avg(epoch_us(ts))) AS BIGINT) FROM events)) - INTERVAL 1 HOUR AS second, max(ts) - INTERVAL 1 HOUR AS last FROM e),
w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS start FROM e)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, user_id, count(*) AS done, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total
FROM w, m WHERE (NOT late OR start + INTERVAL 1 HOUR > second) AND start + INTERVAL 1 HOUR <= last GROUP BY 1, 2""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Windows of an hour, every half hour. Every fiftieth event comes after all others; of these, Spark drops what is late by the
    watermark of the batch before the last, which the first half of the log has set."""
    rows, path = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), folder(spark, "arriving")
    middle = rows.agg(F.timestamp_micros(F.floor(F.avg(F.unix_micros("ts"))).cast("long"))).first()[0]
    for part in ((F.col("event_id") % 50 != 0) & (F.col("ts") <= middle), (F.col("event_id") % 50 != 0) & (F.col("ts") > middle), F.col("event_id") % 50 == 0):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)  # files arrive in this order
    with jobs.keyed_state(spark):  # open windows lie on disk, not in the tasks' memory
        done = jobs.run_to_table(jobs.windowed(jobs.file_stream(spark, path, "*.parquet", at_once=1), "ts", "user_id", "1 hour", "30 minutes", "1 hour"))
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "user_id", "done", "errors", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), t AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS session_start, n FROM t WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed; the last ones of the log stay open."""
    rows = jobs.run_to_table(jobs.sessions(events(spark, d), "ts", "user_id"))
    return rows.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1")
def stream_store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Running hits and misses by key: each batch writes the keys it changed."""
    g = jobs.file_stream(spark, written(table(spark, d, "events").select("user_id", "event_type")), "*.parquet", at_once=1).groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return jobs.run_to_table(g, "update", keys=["user_id"])
