"""Features are taken once for each distinct text, whatever the number of queries, null texts included."""

from pyspark.sql import functions as F

from reportmill.functions import features
from reportmill.operators import pairs
from reportmill.plans import querylog


def test_each_text_is_looked_at_once(spark):
    texts = ["SELECT a FROM Sales.Orders", "SELECT SUM(b) FROM HR.Employee", None]
    q = spark.createDataFrame([(i, i % 4, texts[i % 3]) for i in range(30)], "query_id long, report_id long, sql_text string")
    seen = []

    def f(t):
        seen.append(t.count())
        return features.with_features(t)

    got = querylog.by_text(q, f)
    assert seen == [3]
    key = lambda d: sorted((r.query_id, r.k) for r in d.select("query_id", F.to_json(F.struct(*pairs.FEATURES, "complexity", "intent", "semantic_hash")).alias("k")).collect())
    assert key(got) == key(features.with_features(q))
    assert sorted(map(tuple, pairs.members(got).collect())) == [(i, i % 3) for i in range(30)]
