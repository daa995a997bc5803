"""The pipeline on a small table with planted cases, stage by stage."""

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from reportmill.llm import language, mixing, packing, simhash
from reportmill.operators.shared import store


def test_stages_take_effect(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in base.collect()}
    longest = max(rows.values(), key=lambda r: len(r.text))
    passage = " ".join(f"mark{i}" for i in range(60))
    clean = [r for r in rows.values() if r.lang == "en" and 1000 < len(r.text) < 4000][:2]
    planted = [(9000, longest.text, longest.lang, "src0", 1), (9001, None, "en", "src1", 0), (9002, "12 34 ...", "en", "src1", 9)]
    planted += [(9003 + i, f"{r.text}\n{passage}", "en", "src2", 1) for i, r in enumerate(clean)]
    spark.createDataFrame([*map(tuple, rows.values()), *planted], base.schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == base.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {n: Counter(r.doc_id for r in v) for n, v in kept.items()}
    assert 9001 not in ids["language_id"] and 9002 not in ids["language_id"] and 9000 in ids["language_id"]
    assert len(ids["language_id"]) >= 0.97 * len(rows)

    fps = {r.doc_id: simhash.fingerprint(r.text.encode().lower().split()) % 2**64 for r in kept["language_id"]}
    component = {i: i for i in fps}
    near = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 2]
    for _ in range(20):
        for a, b in near:
            component[a] = component[b] = min(component[a], component[b])
    assert set(ids["simhash_near_dedup"]) == set(component.values()) and 9000 not in component.values()

    before, after = ({r.doc_id: r for r in kept[n]} for n in ("simhash_near_dedup", "substring_dedup"))
    assert set(before) == set(after)
    first = {}
    split = {i: r.text.encode().split() for i, r in before.items()}
    for i in sorted(split):
        for s in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][s : s + 50]), i)
    for i, w in split.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        assert after[i].text.encode().split() == [x for p, x in enumerate(w) if p not in gone]
        assert after[i].n_chars == len(after[i].text) and (gone or after[i].text == before[i].text)

    copies = {r.doc_id: r.copies for r in mixing.copies(spark.read.parquet(str(tmp_path / "substring_dedup"))).collect()}
    assert ids["source_mixing"] == Counter({i: n for i, n in copies.items() if n})
    pieces = kept["best_fit_packing"]
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == ids["source_mixing"]
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.ROOM and len(fill) <= math.ceil(sum(fill.values()) / packing.ROOM) * 1.02 + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(ids["source_mixing"])


INNER = "id key hits fp low label _drop _lang _rate row doc copies copy block place rid carry_0 kept_text sha starts cover class component_id n h w target rate offset before source_size split range bucket".split()


def test_columns_of_any_name_and_an_empty_table_pass_all_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 20)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = store(base.where("doc_id < 60").select("*", *(F.lit(i).alias(c) for i, c in enumerate(INNER))))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns and docs.count() > 0
        assert docs.select(*INNER).distinct().collect() == [tuple(range(len(INNER)))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
    base.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
