"""Streaming forms of ingest, matching, progress and sessions. Sinks are tables; a run takes what is there and ends."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reportmill.operators.shared import folder


def run_to_table(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int, str], None] | None = None, keys: Sequence[str] = (), root: str | None = None) -> DataFrame:
    """Runs a stream over all that is available and returns the rows it wrote.

    In append mode batches are added to a parquet table, so state goes with the watermark and only new rows are written. In
    update mode a batch holds the rows of the keys it changed; of each key the row of the latest batch counts. Progress is
    kept in the shared folder, so a run with the same root goes on where the last one was; a batch that is written again replaces itself.
    """
    with few_stores(stream.sparkSession):
        return _run_to_table(stream, mode, each, keys, root)


def _run_to_table(stream: DataFrame, mode: str, each: Callable[[DataFrame, int, str], None] | None, keys: Sequence[str], root: str | None) -> DataFrame:
    spark = stream.sparkSession
    root = root or folder(spark, "stream")
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if each is not None or mode != "append":
        def write(df: DataFrame, n: int) -> None:
            if each is not None:
                each(df, n, f"{root}/rows/_batch={n}")
            else:
                df.write.mode("overwrite").parquet(f"{root}/rows/_batch={n}")
        q = w.outputMode(mode).foreachBatch(write).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", f"{root}/rows").start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    if mode == "update":
        rest = [c for c in rows.columns if c not in (*keys, "_batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("last"))
        return last.select(*keys, "last.*")
    return rows.drop("_batch")


def file_stream(spark: SparkSession, path: str, pattern: str, at_once: int = 16) -> DataFrame:
    """A stream over a table of parquet files; new files are new rows."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).parquet(path)


def distinct_content(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each content once, as long as the watermark remembers it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, key: str, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Files done, errors and sizes of each key and time window; rows later than delay are dropped."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    g = stream.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "done", "errors", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of activity of each key, apart by at least gap."""
    g = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("s.start").alias("session_start"), "n")


#: Parts of a domain's list, so that a domain which most arrivals have is the state of several tasks.
SALTS = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Catalogue(StatefulProcessor):
    """The signatures of one part of a domain that have arrived, as (sig -> domains).

    Rows are (d, salt, sig, domains, reach, kept): an arrival comes to every domain that it reaches, and is kept, in one part,
    where it has the domain itself. It meets what has arrived before it: earlier batches, and in its own batch the smaller ids.
    Two that could meet at several domains meet at the first of them only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "sig long", "domains string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N803
        domain = key[0]
        held = {k[0]: set(json.loads(v[0])) for k, v in self.known.iterator()}
        for r in sorted(rows, key=lambda r: r.sig):
            if r.sig in held:
                continue
            reach = set(r.reach)
            for sig, domains in held.items():
                if min(reach & domains) == domain:
                    yield Row(new_sig=r.sig, old_sig=sig)
            if r.kept:
                held[r.sig] = set(r.domains)
                self.known.updateValue((r.sig,), (json.dumps(sorted(r.domains)),))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def few_stores(spark: SparkSession) -> Iterator[None]:
    """Inside, streams that begin have two state stores a core, or as many as shuffles have parts, if those are fewer.

    Each batch opens and commits every store, empty ones too, and keyed state starts a worker for each; so more of them take
    time without sharing the work any further. A stream that goes on keeps the stores it has.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), max(SALTS, 2 * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, streams keep their state in RocksDB, which keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def meetings(arrivals: DataFrame) -> DataFrame:
    """(new_sig, old_sig) of arriving signatures (sig, domains, reach) and of those that arrived before and have a domain that the
    new one reaches. Each two meet once, whatever the batches and restarts; the state is a signature's id and domains."""
    spread = arrivals.select("sig", "domains", "reach", F.explode("reach").alias("d")).withColumn("own", F.array_contains("domains", F.col("d")))
    part = F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("kept", F.col("own") & (F.col("salt") == part))
    return spread.groupBy("d", "salt").transformWithState(statefulProcessor=Catalogue(), outputStructType="new_sig long, old_sig long", outputMode="append", timeMode="none")
