"""Result-store upkeep, job progress and roll-ups over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.operators import store
from reportmill.plans.registry import query, table

NOW = "2024-01-31"
LATEST = "(SELECT * FROM (SELECT user_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The store: the last event of each user."""
    return store.latest(events(spark, d), "user_id", ["ts", "event_id"])


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


@query(f"SELECT user_id, event_id, event_type, value FROM {LATEST}")
def store_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH s AS (SELECT user_id FROM {LATEST} WHERE event_type <> 'error' AND ts + INTERVAL 24 HOUR >= TIMESTAMP '{NOW}')
SELECT k.user_id, s.user_id IS NOT NULL AS hit FROM (SELECT DISTINCT user_id FROM events) k LEFT JOIN s USING (user_id)""")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.lookup(events(spark, d).select("user_id").distinct(), entries(spark, d).where("event_type <> 'error'"), "user_id", "ts", now())


@query(f"SELECT event_id, user_id FROM events WHERE ts + INTERVAL 240 HOUR >= TIMESTAMP '{NOW}'")
def store_expire(spark: SparkSession, d: str) -> DataFrame:
    return store.expire(events(spark, d), "ts", now(), 240).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def store_keep_recent_n(spark: SparkSession, d: str) -> DataFrame:
    return store.keep_recent(events(spark, d), [F.desc("ts"), F.col("event_id")], 1000).select("event_id", "user_id")


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS size FROM events), r AS (SELECT *, sum(size) OVER (ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER () AS total FROM e)
SELECT event_id, user_id FROM r WHERE total <= 100000 OR run <= 80000""")
def store_size_budget(spark: SparkSession, d: str) -> DataFrame:
    return store.within_budget(events(spark, d).withColumn("size", F.floor("value")), "size", "ts", "event_id", 100_000).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def store_invalidate_key(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return store.without_keys(e, e.where("event_type = 'error' AND value > 200"), "user_id").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')")
def store_invalidate_tags(spark: SparkSession, d: str) -> DataFrame:
    return store.without_tags(events(spark, d).withColumn("tags", F.array("event_type")), "tags", ["error", "click"]).select("event_id", "event_type")


@query(f"""SELECT count(*) AS before, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS after,
round(100.0 * count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) / count(*), 4) AS dropped_share FROM events""")
def store_age_purge(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("ts") < now() - F.expr("INTERVAL 14 DAYS")
    return events(spark, d).agg(F.count(F.lit(1)).alias("before"), F.count_if(~old).alias("after"), F.round(F.count_if(old) * 100.0 / F.count(F.lit(1)), 4).alias("dropped_share"))


@query("SELECT user_id, CAST(max(ts) AS VARCHAR) AS last_read, count(*) AS reads FROM events GROUP BY user_id")
def store_touch(spark: SparkSession, d: str) -> DataFrame:
    t = store.touched(events(spark, d), "user_id", "ts")
    return t.select("user_id", F.col("last_read").cast("string").alias("last_read"), "reads")


@query(f"""WITH s AS (SELECT user_id, event_id, ts, event_type AS tag FROM {LATEST} UNION ALL SELECT user_id, 1000000000 + user_id, TIMESTAMP '{NOW}', 'warmed' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM s) SELECT user_id, event_id, tag FROM r WHERE r = 1""")
def store_warm(spark: SparkSession, d: str) -> DataFrame:
    old = entries(spark, d).select("user_id", "event_id", "ts", F.col("event_type").alias("tag"))
    warm = old.where("user_id % 10 = 0").select("user_id", (F.col("user_id") + 1_000_000_000).alias("event_id"), now().alias("ts"), F.lit("warmed").alias("tag"))
    return store.latest(old.unionByName(warm), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "tag")


@query("""WITH a AS (SELECT user_id, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT count(DISTINCT user_id) AS entries, count(*) FILTER (gap <= 3600000000) AS memory_hits, count(*) FILTER (gap > 3600000000 AND gap <= 86400000000) AS disk_hits, count(*) FILTER (gap IS NULL OR gap > 86400000000) AS misses,
round(count(*) FILTER (gap <= 86400000000) / count(*), 6) AS hit_rate, round(sum(value), 2) AS size, round(avg(value), 6) AS mean_access FROM a""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """The event log as accesses by user: within an hour of the last one the entry is in memory, within a day on disk, later gone."""
    return store.access_stats(events(spark, d), "user_id", ["ts", "event_id"], F.unix_micros("ts"), "value", 3_600_000_000, 86_400_000_000)


@query("""SELECT user_id, count(*) AS files, round(sum(value), 4) AS bytes, count(*) FILTER (event_type = 'error') = 0 AS succeeded, CASE WHEN user_id IS NULL THEN 'total' WHEN count(*) > 20 THEN 'background' ELSE 'direct' END AS kind FROM events GROUP BY ROLLUP (user_id)""")
def job_history(spark: SparkSession, d: str) -> DataFrame:
    """A user stands for a job; jobs of more than 20 files run in the background."""
    g = events(spark, d).rollup("user_id").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("value"), 4).alias("bytes"), (F.count_if(F.col("event_type") == "error") == 0).alias("succeeded"))
    return g.withColumn("kind", F.when(F.col("user_id").isNull(), "total").when(F.col("files") > 20, "background").otherwise("direct"))


@query("""SELECT CAST(floor(event_id / 10) AS BIGINT) AS batch, count(*) AS files, CAST(max(epoch(ts)) - min(epoch(ts)) AS BIGINT) AS seconds, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM events GROUP BY 1""")
def batch_timings(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    s = F.unix_micros("ts") / 1e6
    return events(spark, d).groupBy(F.floor(F.col("event_id") / 10).alias("batch")).agg(n.alias("files"), F.round(F.max(s) - F.min(s)).cast("long").alias("seconds"), (n * (n - 1) / 2).cast("long").alias("pairs"))


@query("""SELECT user_id, n, round(total, 4) AS total FROM (SELECT user_id, count(*) AS n, sum(value) AS total, max(ts) AS last FROM events GROUP BY user_id) ORDER BY last DESC, user_id LIMIT 5""")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))
    return g.orderBy(F.desc("last"), "user_id").limit(5).select("user_id", "n", F.round("total", 4).alias("total"))


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, done, total, round(100.0 * done / total, 4) AS percent, round(us * (total - done) / 1e6 / done, 4) AS eta FROM p""")
def progress_eta(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    p = events(spark, d).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("done"), F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("total"), (F.unix_micros("ts") - F.first(F.unix_micros("ts")).over(w)).alias("us"))
    return p.select("event_id", "user_id", "done", "total", F.round(F.col("done") * 100.0 / F.col("total"), 4).alias("percent"), F.round(F.col("us") * (F.col("total") - F.col("done")) / 1e6 / F.col("done"), 4).alias("eta"))
