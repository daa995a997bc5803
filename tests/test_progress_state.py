"""The state of open windows is kept in RocksDB."""

from reportmill.plans import streams
from reportmill.streaming import jobs


def test_open_windows_are_no_memory_of_a_task(spark, monkeypatch):
    seen, run = [], jobs.run_to_table
    monkeypatch.setattr(jobs, "run_to_table", lambda *a, **k: seen.append(spark.conf.get("spark.sql.streaming.stateStore.providerClass")) or run(*a, **k))
    assert streams.stream_progress(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [jobs.ROCKS]
