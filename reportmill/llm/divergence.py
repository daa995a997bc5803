"""Audit of how far the sources of a language diverge in their words, by in-mapper stripes.

A task folds whole documents into stripes, one a term and language: in how many documents the term stands, and how often it
stands in each source. Full stripes are spilled as rows and go to the task of their term, where the spills of a term are
merged. A merged stripe has everything that its term adds to any divergence, so stripes emit divergences directly: term by
term against the whole language, and pair by pair of the sources that have the term. What pairs gain from terms that only
one of them or neither has follows from counts of counts, which are small, so no pair is written out for a term that it lacks.

All arithmetic is in integers; products that pass 64 bits are decimals. Empty strings stand for nulls. A language without a
kept term has pairs of value 0 and no terms; a group without a term is a source like any other. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportmill.llm.common import raw
from reportmill.operators.shared import store

#: A term is kept from so many documents of its language on.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Terms that a report names, for each source.
TERMS = 200
#: Cells (a term in a source) that a task holds before it spills its stripes.
CELLS = 600_000
#: Rows in a batch that is spilled.
BATCH = 100_000
#: The words of UTF-8 text: letters from A to Z and everything beyond ASCII.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
_STRIPE = "lang string, term string, cells array<struct<source: string, n: bigint, documents: bigint>>"


class Stripes:
    """Stripes of one task; the cells of a stripe are held by source, so that whole documents are counted at once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def fold(self, lang: str, source: str, text: bytes) -> None:
        words = WORD.findall(text.lower())  # bytes lower ASCII letters alone
        self.n[lang, source].update(words)
        self.documents[lang, source].update(set(words))

    def cells(self) -> int:
        return sum(map(len, self.n.values()))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows; each cell brings its source's occurrences and documents."""
        by_lang: dict[str, list[str]] = defaultdict(list)
        for lang, source in self.n:
            by_lang[lang].append(source)
        for lang, sources in by_lang.items():
            number: dict[bytes, int] = {}
            rows, n, documents, sizes = [], [], [], []
            for source in sources:
                counts = self.n[lang, source]
                rows += [number.setdefault(term, len(number)) for term in counts]
                n += counts.values()
                documents += map(self.documents[lang, source].__getitem__, counts)
                sizes.append(len(counts))
            row = np.array(rows, np.int64)
            order = np.argsort(row, kind="stable")
            cells = [pa.array(sources, pa.string()).take(pa.array(np.repeat(np.arange(len(sources)), sizes)[order])), *(pa.array(np.array(v, np.int64)[order]) for v in (n, documents))]
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(number)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(cells, ["source", "n", "documents"]))
            terms = pa.array(list(number), pa.binary()).cast(pa.string())
            whole = pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(number), np.int64))), terms, lists], ["lang", "term", "cells"])
            yield from (whole.slice(at, BATCH) for at in range(0, len(number), BATCH))
        self.clear()


def stripes(docs: DataFrame) -> DataFrame:
    """Merged stripes of (lang, source, text): one row a language and term, with the cells of its sources, kept terms only.

    Spills meet by term in one shuffle; a term's row holds one cell a source, however many documents have it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
                held.fold(lang, source, text)
            if held.cells() > CELLS:
                yield from held.spill()
        if held.n:
            yield from held.spill()
    spilled = docs.mapInArrow(run, _STRIPE).repartition("lang", "term")
    cell = spilled.select("lang", "term", F.inline("cells")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    merged = cell.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    return merged.where(F.col("documents") >= LEAST_DOCUMENTS).select("lang", "term", "cells", "n")


def _p(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms))."""
    return F.expr("1 + CAST(__count + 1 AS DECIMAL(28, 0)) * __scale div (__total + __terms)".replace("__scale", f"CAST({SCALE} AS DECIMAL(10, 0))").replace("__count", count).replace("__total", total).replace("__terms", terms))


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square stays below 2^63."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): every source of a language against each other one (`pair`, all ranks) and its
    terms that stand out from the language (`term`, ranks to TERMS), by value and then by item."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text"))
    kept = store(stripes(d))
    cells = kept.select("lang", "term", F.col("n").alias("n_lang"), F.inline("cells"))

    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total_lang"))
    per_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("known"))
    groups = d.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = store(groups.select("lang", "source", *map(zero, ("total", "known", "v", "total_lang"))))
    some = groups.where("v > 0").withColumn("p0", _p("0", "total", "v"))

    each = cells.join(some, ["lang", "source"]).withColumn("p", _p("n", "total", "v"))
    term = each.withColumn("q", _p("n_lang", "total_lang", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    return _ranked(term, TERMS).unionByName(_ranked(_pairs(groups, some, each), None))


def _pairs(groups: DataFrame, some: DataFrame, each: DataFrame) -> DataFrame:
    """Values of pairs. With p0, q0 for a count of zero, the sum over all terms is f(p0, q0) for each of them, and for each
    term of one side f with its own count less f(p0, q0); a term that both have is corrected by what that counted wrong."""
    mine, other = some.alias("a"), some.alias("b")
    base = mine.join(other, F.expr("a.lang = b.lang AND a.source <> b.source")).select("a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (_f("a.p0", "b.p0") * F.expr("a.v - a.known - b.known")).alias("value"))

    counts = each.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    met = counts.alias("c").join(other, F.expr("c.lang = b.lang AND c.source <> b.source"))
    left = met.select("c.lang", F.col("c.source").alias("source"), F.col("b.source").alias("item"), (_f("c.p", "b.p0") * F.col("times")).alias("value"))
    right = met.select("c.lang", F.col("b.source").alias("source"), F.col("c.source").alias("item"), (_f("b.p0", "c.p") * F.col("times")).alias("value"))

    stripe = each.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells")).where(F.size("cells") > 1)
    both = stripe.select("lang", "cells", F.explode("cells").alias("x")).select("lang", "x", F.explode("cells").alias("y")).where("x.source <> y.source")
    fixed = _f("x.p", "y.p") - _f("x.p", "y.p0") - _f("x.p0", "y.p") + _f("x.p0", "y.p0")
    both = both.select("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), fixed.alias("value"))

    parts = [x.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")) for x in (base, left, right, both)]
    known = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    bare = groups.where("v = 0")
    none = bare.alias("a").join(bare.alias("b"), F.expr("a.lang = b.lang AND a.source <> b.source")).select("a.lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    return known.unionByName(none).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _ranked(rows: DataFrame, most: int | None) -> DataFrame:
    """rows with their rank in a group; Spark drops what lies beyond most before it shuffles."""
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", place)
    return ranked.where(F.col("rank") <= most) if most else ranked


_D = "(SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id, row_number() OVER () AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)"
ORACLE_SQL = rf"""WITH d AS MATERIALIZED (SELECT * FROM {_D}),
w AS MATERIALIZED (SELECT lang, source, term, count(*) AS docs, sum(n) AS n FROM (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n_lang FROM w GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total FROM kept GROUP BY 1),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(y.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM w JOIN kept USING (lang, term) GROUP BY ALL) y USING (lang, source)),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(w.n, 0)::HUGEINT AS n, 1 + 1000000000 * (coalesce(w.n, 0)::HUGEINT + 1) // (g.total + v.v) AS p, 1 + 1000000000 * (k.n_lang + 1) // (v.total + v.v) AS q FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
r AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM c WHERE n > 0 AND p > q
UNION ALL SELECT a.lang, a.source, 'pair', b.source, coalesce(s.value, 0) FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM c x JOIN c y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""
