"""More languages than share a batch."""

import numpy as np
from pyspark.sql import functions as F

from reportmill.llm import language


def test_every_language_is_learned_and_kept(spark):
    draw, n = np.random.default_rng(3), 80
    word = lambda k: "".join(chr(0x4E00 + 64 * k + int(draw.integers(12))) for _ in range(4))
    rows = [(100 * k + i, " ".join(word(k) for _ in range(30)), f"l{k:02}") for k in range(n) for i in range(6 + (k < 64))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = language.fit(docs, F.lit(False))
    assert model[0] == [f"l{k:02}" for k in range(n)]
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows if lang >= "l64"]) > 0.9
    mixed = docs.withColumn("text", F.concat_ws(" ", "text", F.lit("12 34 ...")))
    assert language.keep_known(mixed, F.lit(False)).count() == len(rows)


def test_a_doubtful_language_is_kept_as_labelled_documents_are(spark):
    """Two languages in equal words cannot be told apart by more than chance among many; none of their documents goes."""
    draw = np.random.default_rng(4)
    rows = [(100 * k + i, " ".join("".join(chr(97 + int(draw.integers(26))) for _ in range(5)) for _ in range(30)), f"l{k}") for k in range(6) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert language.keep_known(docs, F.lit(False)).count() == len(rows)
