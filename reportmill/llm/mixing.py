"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's target over its size. Along a fixed order of the
source's documents these expectations are prefix-summed, one offset drawn for the source is added, and a document is emitted
once for each integer that its stretch of the sum crosses. The order goes by size, so that every run of neighbours has
documents of like size: the words taken differ from the target by the size of the longest document at most.

The prefix sum has two levels, so that a source with a third of all rows is many tasks: documents are numbered inside
blocks of a source (a size class, split by a hash of the id), and a small table of block counts is summed per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.llm.common import SPACE
from reportmill.operators.shared import cut, numbered, store

MOST = 3
WEIGHTS = (1, 2, 3)
SPLITS = 64
OFFSETS = 1 << 20


def _row(id_col: str, text_col: str, source_col: str) -> Column:
    """What mixing needs of a row, in one column: id, size (words), source (never null) and the block: class by size, split by id."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("1"), F.col(source_col)), F.lit("2"))
    split = F.coalesce(F.pmod(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4), 16, 10).cast("int"), F.lit(SPLITS)), F.lit(0))
    return F.struct(F.col(id_col).alias("id"), size.alias("size"), source.alias("source"), split.alias("split"))


def _class(size: Column) -> Column:
    """Four classes for each doubling of the size."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size.cast("long"), F.greatest(bits - 3, F.lit(0)).cast("int"))).cast("int")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target and rate.

    Sources in order of their code points, null last, weigh 1, 2, 3, 1, ... and share all words; a source stops at three
    times its size and the rest share the excess by weight. The level of the rest rises as sources are capped, and each
    pass caps all that it reaches, until none is above: two sums a pass, and as many passes as the level has steps.
    """
    w = numbered(sizes, "place", "source")
    w = cut(w.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1)))
    every = w.agg(F.sum("source_size")).first()[0] or 0
    fixed, open_, capped = 0, None, F.lit(False)
    while True:
        s = w.agg(F.sum(F.when(capped, F.col("source_size") * MOST).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if (s[0] or 0, s[1] or 0) == (fixed, open_):
            break
        fixed, open_ = s[0] or 0, s[1] or 0
        capped = F.col("source_size") * MOST * F.lit(open_).cast("decimal(38,0)") <= F.col("weight") * F.lit(every - fixed).cast("decimal(38,0)")
    target = F.when(capped, (F.col("source_size") * MOST).cast("double")).otherwise(F.col("weight") * F.lit(float(every - fixed)) / F.lit(float(open_ or 1)))
    rate = F.coalesce(F.least(F.lit(float(MOST)), F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0.0))
    return w.withColumn("target", target.cast("double")).select("source", "source_size", "target", rate.alias("rate"))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row a block of rows' `row`: as struct `block`, what its documents share, joined by (source, class, split)."""
    counts = cut(rows.groupBy("row.source", _class(F.col("row.size")).alias("class"), "row.split").agg(F.count(F.lit(1)).alias("n"), F.sum("row.size").alias("words")))
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.col("source"))), 1, 5), 16, 10).cast("long") / OFFSETS
    blocks = counts.select("source", "class", "split", before.alias("before"), offset.alias("offset")).join(targets, "source")
    return blocks.select(F.struct(*blocks.columns).alias("block"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (row, ...) with block and copies: how many integers the row's stretch of its source's prefix sum crosses."""
    key = lambda r: (r["source"], _class(r["size"]), r["split"])
    inside = F.row_number().over(W.partitionBy(*key(F.col("row"))).orderBy("row.size", "row.id"))
    blocks = _blocks(rows)
    source, size_class, split = key(F.col("row"))
    placed = rows.withColumn("place", inside).join(blocks, (source == F.col("block.source")) & (size_class == F.col("block.class")) & (split == F.col("block.split")))
    upto = lambda k: F.floor((F.col("block.before") + F.col("place") - k) * F.col("block.rate") + F.col("block.offset"))
    return placed.withColumn("copies", F.least(F.lit(MOST), upto(0) - upto(1)).cast("int"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, copies): how often each row of docs is taken."""
    rows = _placed(cut(docs.select(_row(id_col, text_col, source_col).alias("row"))))
    return rows.select(F.col("row.id").alias("doc_id"), "row.size", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of docs; taken counts words, repeats included.

    The words that a source takes are no further from its target than the size of its longest document. A null text has no
    words; a null source is a source of its own, the last. Rows that agree in id and size may swap their copies. Other
    columns are left out. An empty table gives no rows. The same rows give the same mix.
    """
    rows = _placed(cut(docs.select(_row(id_col, text_col, source_col).alias("row"))))
    return rows.select(F.col("row.id").alias("doc_id"), "row.size", "block.source_size", "block.target", (F.col("row.size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs with all their columns, whatever their names, each as many times as it is taken."""
    kept = store(docs.select(_row(id_col, text_col, source_col).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")))
    rows = _placed(kept).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('1' || source, '2') AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
e AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS c,
    coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 64, 0) AS p FROM d),
n AS (SELECT s, sum(size) AS source_size, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS w FROM e GROUP BY s),
o AS (
  SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS ws,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    coalesce(sum(w) OVER (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM n),
q AS (SELECT *, 3 * source_size * (ws - spent) <= w * (t - given) AS capped FROM o),
r AS (
  SELECT s, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN capped THEN 3 * source_size
    ELSE w * (t - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS DOUBLE) AS target FROM q),
f AS (
  SELECT e.*, r.source_size, r.target, CASE WHEN r.source_size = 0 THEN 0.0 ELSE least(3.0, r.target / r.source_size) END AS rate,
    row_number() OVER (PARTITION BY e.s ORDER BY c, p, size, doc_id) AS k,
    CAST('0x' || substr(md5('mix' || e.s), 1, 5) AS BIGINT) / 1048576.0 AS u FROM e JOIN r USING (s))
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(k * rate + u) - floor((k - 1) * rate + u)) AS BIGINT) AS taken FROM f
"""
