"""The threshold of the pipeline's first stage counts every labelled document, not the sample that taught the model."""

from pyspark.sql import functions as F

from reportmill.llm import language


def test_no_labelled_document_is_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(language, "DOCS", 25)
    monkeypatch.setattr(language, "STEPS", 10)
    words = {"en": "the house and water", "de": "das haus und wasser"}
    rows = [(i, " ".join(words["en" if i % 2 else "de"].split()[: 1 + i % 4]) + f" {'qxz'[i % 3] * (i % 17)}", "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.keep_known(docs, F.lit(False), share=1.0).count() == len(rows)
