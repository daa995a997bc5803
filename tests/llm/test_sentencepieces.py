"""Encoding and decoding against the library itself, with this model and with models of other normalisation."""

import hashlib
import random

import numpy as np
import pytest

from reportmill.llm import sentencepieces as S

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", " a ", "▁▁a", "▁", "x" * 5000, "<s> </s><unk> <0x41>", "漢" * 500, "é 漢字 \0 \t\n 😀", "one two three " * 3000]


def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def spans(sp, text):
    return [(p.id, p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]


def normalised(rule, squeeze, prefix=True):
    """The public model with another compiled character map; its pieces stay as they are."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, spec = pb.ModelProto(), pb.NormalizerSpec()
    m.ParseFromString(S._model(None))
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    m.normalizer_spec.precompiled_charsmap, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = spec.precompiled_charsmap, squeeze, prefix
    return m.SerializeToString()


@pytest.mark.parametrize("model", [None, ("nmt_nfkc", False), ("nmt_nfkc", True), ("nfkc_cf", True), ("nfkc", False, False)])
def test_pieces_spans_and_texts(spark, model):
    blob = normalised(*model) if model else S._model(None)
    sp, encoder, decoder = library(blob), S.Encoder(blob), S.Decoder(blob)
    random.seed(7)
    signs = " ▁ab<s>0x\n\t漢é😀\0́①ﬁｶﾞÅⅷ½　​.  "
    texts = ODD + ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(800)] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(100).collect()]
    offsets, ids, begins, ends = encoder.encode([t.encode() for t in texts])
    back = decoder.decode(offsets, ids.astype(np.int64))
    for k, t in enumerate(texts):
        part = slice(offsets[k], offsets[k + 1])
        want = spans(sp, t)
        assert list(zip(ids[part].tolist(), begins[part].tolist(), ends[part].tolist())) == want, t[:50]
        assert back[k] == sp.decode([w[0] for w in want]), t[:50]


def test_decoding_of_any_ids():
    blob = S._model(None)
    sp, decoder = library(blob), S.Decoder(blob)
    random.seed(3)
    lists = [[], [0], [1, 2], [230, 131], [35, 29871], [29871, 29871], [1, 29871, 5], [195, 172, 450]] + [[random.choice((random.randrange(32000), random.randrange(3, 259))) for _ in range(random.randint(1, 12))] for _ in range(500)]
    offsets = np.append(0, np.cumsum([len(x) for x in lists]))
    got = decoder.decode(offsets, np.array([i for x in lists for i in x], np.int64))
    for x, text in zip(lists, got):
        assert text == sp.decode(x), x


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(S, "CACHED", 5)
    encoder, sp = S.Encoder(S._model(None)), library(S._model(None))
    for batch in range(6):
        texts = [f"word{batch}{i} again {i}" for i in range(20)]
        offsets, ids, _, _ = encoder.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == sp.encode(texts)
        assert len(encoder.count) <= 5 + 60


def test_invalid_bytes_are_replaced():
    text, src = S.valid(b"a\xff\xe6\xbc b")
    assert text.decode() == "a��� b" and src.tolist() == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5]


def test_query_rows(spark):
    sp = library(S._model(None))
    rows = [(i, t, "x", 1) for i, t in enumerate([None, *ODD, "same", "same"])] + [(None, "no id", "x", 1), (3, "second of an id", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, begins long").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, S.digests(docs).collect()), key=key) == sorted(want, key=key)
    assert S.digests(docs.limit(0)).collect() == []


def test_whole_table(spark):
    sp = library(S._model(None))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    for r in S.digests(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
