"""Quality rules with risk-controlled thresholds.

Four measures of a text fall into cells of a fixed grid. A document's rarity is the share of its stratum's unlabelled
documents that are as far out or further in the measure where it is furthest out, each measure by its weight. A threshold
rejects what is rarer; along a fixed grid of thresholds, from none to half of the stratum, rejections only grow.

A threshold may be used in a stratum only if the labelled good documents held out there show, by an exact binomial test,
that it rejects at most ALPHA of the good ones, all measures together. Inside a stratum the tests run in a fixed sequence
that ends at the first failure; across strata the level DELTA is divided (Bonferroni). So with probability 1 - DELTA no
stratum loses more than ALPHA of its good documents. Of the certified thresholds that one is taken that rejects most
labelled bad documents less good ones, the loosest on a tie; it is handed on as one cutoff a measure. A stratum with too few
labels certifies nothing, and loses nothing: with four strata, 217 good documents without a rejection are enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.llm.common import SPACE, log_factorial
from reportmill.operators.shared import cut

ALPHA = 0.02
DELTA = 0.05
GRID = 64
#: Thresholds that are tried: the squares of their share of all, up to MOST of the stratum.
STEPS, MOST = 64, 0.5
#: A broadcast of one row a stratum is made up to so many strata; beyond, rows are joined by shuffle.
BROADCAST_STRATA = 10_000
WHITE = " \t\n\x0b\x0c\r"
#: Measures with their weights: symbols hardly occur in good prose, so their threshold may be the tightest.
MEASURES = {"symbols": 8, "lines": 1, "repeats": 1, "length": 2}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text.

    Repeated windows are found inside the row, by sorting the hashes of its 3-word windows, so no word is shuffled.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("doc_id", "stratum", "t", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"))
    t = t.select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.length(F.translate("t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    rest = [c for c in t.columns if c != "h"]
    found = F.size("h") > F.size(F.array_distinct("h"))
    t = t.select(*rest, F.when(found, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    twice = F.filter(F.transform("s", lambda s, i: F.when((s["x"] == F.get("s", i - 1)["x"]) | (s["x"] == F.get("s", i + 1)["x"]), s["i"])), lambda i: i.isNotNull())
    t = t.select(*rest, F.array_sort(twice).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return t.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _cells(m: DataFrame) -> DataFrame:
    """m with cells: for each measure, its cell of the grid, 0 to GRID - 1; more is worse."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_dup_lines") * 8 / words, F.col("n_repeat_words") / words, F.col("word_chars") / words / 40]
    return m.withColumn("cells", F.array(*(F.least(F.lit(GRID - 1), F.floor(F.sqrt(v) * GRID)).cast("int") for v in values)))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n trials, exact where it is below one half; 1 where k is above n p.

    Terms are summed from k downwards relative to the first; below 40 standard deviations they no longer count.
    """
    first = log_factorial(n.cast("double")) - log_factorial(k.cast("double")) - log_factorial((n - k).cast("double")) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100).cast("long")
    step = lambda a, j: F.struct((a["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("s"))
    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def tails(cells: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(stratum, tail): for each measure and cell, the share of unlabelled documents in that cell or above. A row a stratum."""
    labelled = labels.select(F.col(id_col).alias("label_id")).where("label_id is not null").distinct()
    tall = cells.join(labelled, F.col("doc_id") == F.col("label_id"), "left_anti").select("stratum", F.posexplode("cells").alias("measure", "cell"))
    counts = tall.groupBy("stratum", "measure", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("stratum").agg(F.collect_list(F.struct("measure", "cell", "n")).alias("c"))

    def tail(measure: int) -> Column:
        above = lambda x: F.aggregate(F.filter("c", lambda r: (r["measure"] == measure) & (r["cell"] >= x)), F.lit(0).cast("long"), lambda a, r: a + r["n"])
        return F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda x: above(x) / above(F.lit(0)))

    return counts.select("stratum", F.array(*map(tail, range(len(MEASURES)))).alias("tail"))


def cutoffs(cells: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): the chosen cutoff of each measure, GRID where none is certified. One row a stratum.

    An id that is labelled more than once counts once, as bad if any label says so; an id of several documents labels each.
    Labels that are null say nothing. A stratum without unlabelled documents has nothing to compare with and rejects none.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("good"))
    rare = cut(tails(cells, labels, id_col)).toDF("in_stratum", "tail")
    rare = F.broadcast(rare) if rare.count() <= BROADCAST_STRATA else rare
    held = cells.join(known, cells.doc_id == known.label_id).join(rare, F.col("stratum").eqNullSafe(F.col("in_stratum")))
    rarity = F.least(*(F.get(F.get("tail", F.lit(i)), F.get("cells", F.lit(i))) / w for i, w in enumerate(MEASURES.values())))
    level = lambda j: F.pow(j / STEPS, F.lit(2)) * MOST
    step = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(STEPS)), lambda j: F.col("rarity") <= level(j)))
    counts = held.select("stratum", "good", rarity.alias("rarity")).groupBy("stratum", F.coalesce(step, F.lit(STEPS + 1)).alias("step")).agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
    grid = cut(counts.groupBy("stratum").agg(F.collect_list(F.struct("step", "good", "bad")).alias("c"), F.sum("good").alias("n")))
    upto = lambda j, what: F.aggregate(F.filter("c", lambda x: x["step"] <= j), F.lit(0).cast("long"), lambda a, x: a + x[what])
    tests = grid.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step"), "c").select("stratum", "n", "step", upto(F.col("step"), "good").alias("good"), upto(F.col("step"), "bad").alias("bad"))
    passed = binomial_tail(F.col("n"), F.col("good"), alpha) <= delta / max(1, grid.count())
    certified = tests.withColumn("passed", F.min(passed).over(W.partitionBy("stratum").orderBy("step")))
    best = certified.groupBy("stratum").agg(F.max(F.when(F.col("passed") & (F.col("bad") > F.col("good")), F.struct((F.col("bad") - F.col("good")).alias("gain"), (-F.col("step")).alias("less"))))["less"].alias("less"))
    chosen = best.where("less is not null").join(rare, F.col("stratum").eqNullSafe(F.col("in_stratum")))
    within = lambda i, w: F.array_min(F.filter(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda x: F.get(F.get("tail", F.lit(i)), x) / w <= level(-F.col("less"))))
    return chosen.select("stratum", *(F.coalesce(within(i, w), F.lit(GRID)).alias(f"cut_{m}") for i, (m, w) in enumerate(MEASURES.items())))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): one row per row of docs.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. A null text counts as empty and
    fails. A null stratum is a stratum of its own. Without labels only the base rules reject. Other columns are left out.
    """
    cells = cut(_cells(measures(docs, id_col, text_col, stratum_col)))
    cuts = cut(cutoffs(cells, labels).withColumnRenamed("stratum", "cut_stratum"))
    few = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    joined = cells.join(few, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    over = F.lit(False)
    for i, m in enumerate(MEASURES):
        over = over | (F.get("cells", F.lit(i)) >= F.coalesce(F.col(f"cut_{m}"), F.lit(GRID)))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~over).alias("kept"))


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM documents),
y AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM y) WHERE c > 1) GROUP BY doc_id),
m AS MATERIALIZED (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN z USING (doc_id)),
c AS MATERIALIZED (SELECT *, list_transform([n_symbols / greatest(word_chars, 1), n_dup_lines * 8 / greatest(n_words, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1) / 40], lambda v: least({GRID - 1}, CAST(floor(sqrt(v) * {GRID}) AS INT))) AS cells FROM m),
l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
v AS (SELECT lang, unnest([0, 1, 2, 3]) AS measure, unnest(cells) AS cell FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
a AS MATERIALIZED (SELECT lang, measure, x AS cell, count(*) FILTER (cell >= x) / count(*) AS tail FROM v, (SELECT unnest(range(0, {GRID})) AS x) GROUP BY 1, 2, 3),
r AS MATERIALIZED (SELECT c.doc_id, c.lang, min(a.tail / {list(MEASURES.values())}[c.measure + 1]) AS rarity FROM (SELECT doc_id, lang, row_number() OVER () AS rid, unnest([0, 1, 2, 3]) AS measure, unnest(cells) AS cell FROM c WHERE doc_id IN (SELECT doc_id FROM l)) c
  JOIN a ON a.lang IS NOT DISTINCT FROM c.lang AND a.measure = c.measure AND a.cell = c.cell GROUP BY c.doc_id, c.lang, rid),
g AS MATERIALIZED (SELECT r.lang, step, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND rarity <= pow(step / {STEPS}, 2) * {MOST}) AS k, count(*) FILTER (good <> 1 AND rarity <= pow(step / {STEPS}, 2) * {MOST}) AS bad
  FROM r JOIN l USING (doc_id), (SELECT unnest(range(1, {STEPS} + 1)) AS step) GROUP BY 1, 2),
p AS (SELECT *, (SELECT count(*) FROM g WHERE step = 1) AS tests, CASE WHEN k > n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END AS tail FROM g),
f AS (SELECT *, bool_and(tail <= {DELTA} / tests) OVER (PARTITION BY lang ORDER BY step) AS passed FROM p),
b AS (SELECT lang, step FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY bad - k DESC, step) AS o FROM f WHERE passed AND bad > k) WHERE o = 1),
x AS MATERIALIZED (SELECT b.lang, measure, min(cell) AS cutoff FROM b JOIN a ON a.lang IS NOT DISTINCT FROM b.lang AND a.tail / {list(MEASURES.values())}[a.measure + 1] <= pow(step / {STEPS}, 2) * {MOST} GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT EXISTS (SELECT 1 FROM x WHERE x.lang IS NOT DISTINCT FROM c.lang AND c.cells[x.measure + 1] >= x.cutoff) AS kept FROM c
"""
