"""The divergence audit against brute force in whole numbers."""

import re
from collections import Counter, defaultdict

import pytest

from reportmill.llm import divergence as D

SCALE = 10**9


def brute(rows):
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    rows = [(a or "", b or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in set(r[2]))
        kept = {w for w, n in df.items() if n >= 3}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        p = lambda c, w: 1 + SCALE * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, y: (x - y) ** 2 // y
        for s in count:
            pairs = [(t, sum(f(p(count[s], w), p(count[t], w)) for w in kept)) for t in count if t != s]
            terms = [(w, f(p(count[s], w), p(whole, w))) for w in kept if count[s][w] and p(count[s], w) > p(whole, w)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items if part == "pair" else items[:200], 1)]
    return sorted(out)


ROWS = [("en", "a", "The cat the CAT sat"), ("en", "a", "the cat"), ("en", "b", "The dog é É Éa"), ("en", "b", "dog the"), ("en", None, "dog dog cat"), ("en", "c", None), ("en", "c", "!!! 12"), (None, None, None), (None, "x", ""), ("fr", "a", "un"), ("fr", "b", "deux"),
        ("de", "a", "ja " * 4000), ("de", "b", "ja nein"), ("de", "b", "ja nein"), ("de", "b", "ja nein"), ("xx", "only", "w w w"), ("xx", "only", "w"), ("xx", "only", "w")]


@pytest.mark.parametrize("cells", [400_000, 2])
def test_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(D, "CELLS", cells)
    docs = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(ROWS)], "doc_id long, lang string, source string, text string, term string, n int").repartition(4)
    got = sorted(map(tuple, D.audit(docs).collect()))
    assert got == brute(ROWS)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_many_sources(spark):
    """Sources that share few terms: what pairs of sources lack is summed from counts of counts."""
    rows = [("en", f"s{i}", " ".join([f"w{i % 7}", f"w{i % 5}", "all", f"own{i}"] * (1 + i % 3))) for i in range(40) for _ in range(2)]
    got = sorted(map(tuple, D.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)).collect()))
    assert got == brute(rows)


def test_counts_beyond_64_bits(spark):
    """1e9 times a count of 5e10 passes 64 bits."""
    rows = spark.createDataFrame([(50_000_000_000, 70_000_000_000, 12)], "n long, t long, v long")
    assert rows.select(D._p("n", "t", "v")).collect()[0][0] == 1 + SCALE * 50_000_000_001 // 70_000_000_012
