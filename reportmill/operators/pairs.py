"""Scores of pairs of queries, over distinct signatures.

All scores are functions of a query's features, so queries with equal features are one signature with a count, and pairs
are formed between signatures only. Signatures meet through their domains: a pair below the domain limit shares no equal or
related domain, so an equi-join on domains loses nothing (for limits above that of strangers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import rules

FEATURES = ("tables", "columns", "functions", "joins", "filters", "aggregations")
SAME, KIN, STRANGE = 1.0, 0.6, 0.1
LIMIT = 0.3


def signatures(featured: DataFrame) -> DataFrame:
    """(sig, n, features): one row for each distinct set of features; sig is the smallest query id of it."""
    extra = ("complexity", "intent", "domains", "semantic_hash", "canonical", "grouped", "sorted", "operations", "statement")
    return featured.groupBy(*FEATURES).agg(F.min("query_id").alias("sig"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in extra))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def related(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for x, y in rules.RELATED:
        out = out | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return out


def compatibility(a: Column, b: Column) -> Column:
    """Mean over all pairs of two lists of domains: same, related or strange."""
    one = lambda x: F.aggregate(b, F.lit(0.0), lambda s, y: s + F.when(x == y, SAME).when(related(x, y), KIN).otherwise(STRANGE))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + one(x)) / (F.size(a) * F.size(b))


def reach(domains: Column) -> Column:
    """The domains of a list and those related to one of them: where a partner above the score of strangers can be."""
    kin = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for p in rules.RELATED for x, y in (p, p[::-1])))
    return F.array_distinct(F.concat(domains, F.transform(F.filter(kin, lambda p: F.array_contains(domains, p["x"])), lambda p: p["y"])))


def scored_pairs(sigs: DataFrame, met: DataFrame, a: str, b: str, limit: float = LIMIT) -> DataFrame:
    """Pairs of signatures given by their ids, with every dimension."""
    x = sigs.withColumn("vector", structure_vector())
    side = lambda c, name: x.select(F.col("sig").alias(c), F.struct("*").alias(name))
    p = met.join(side(a, "a"), a).join(side(b, "b"), b)
    return _dimensioned(p.withColumn("compat", compatibility(F.col("a.domains"), F.col("b.domains"))).where(F.col("compat") >= limit))


def domain_pairs(sigs: DataFrame, limit: float = LIMIT, others: DataFrame | None = None) -> DataFrame:
    """(d1, d2, compat): pairs of distinct domain lists at or above limit; d2 from others, where they are given."""
    spread = lambda x: x.select("domains").distinct().select("domains", F.explode(F.array_distinct("domains")).alias("d"))
    each = spread(sigs)
    kin = F.array(*(F.struct(F.lit(x), F.lit(y)) for x, y in rules.RELATED))
    near = F.filter(F.transform(kin, lambda p: F.when(p["col1"] == F.col("d"), p["col2"]).when(p["col2"] == F.col("d"), p["col1"])), lambda x: x.isNotNull())
    reach = each.select(F.col("domains").alias("d1"), F.explode(F.concat(F.array("d"), near)).alias("d"))
    met = reach.join((each if others is None else spread(others)).select(F.col("domains").alias("d2"), "d"), "d").select("d1", "d2").distinct()
    return met.withColumn("compat", compatibility(F.col("d1"), F.col("d2"))).where(F.col("compat") >= limit)


def candidates(sigs: DataFrame, limit: float = LIMIT, others: DataFrame | None = None) -> DataFrame:
    """Pairs a.sig < b.sig of compatible signatures, as structs a and b, with compat; with others, all pairs of a of sigs and b of others."""
    second = sigs if others is None else others
    doms = domain_pairs(sigs, limit, others)
    a, b = sigs.select(F.struct("*").alias("a"), F.col("domains").alias("d1")), second.select(F.struct("*").alias("b"), F.col("domains").alias("d2"))
    met = a.join(doms, "d1").join(b, "d2")
    return (met.where("a.sig < b.sig") if others is None else met).select("a", "b", "compat")


def both(f: str) -> tuple[Column, Column]:
    return F.col(f"a.{f}"), F.col(f"b.{f}")


def basic() -> Column:
    x, y = both("complexity")
    return F.col("compat") * 0.5 + jaccard(*both("tables")) * 0.15 + jaccard(*both("columns")) * 0.15 + jaccard(*both("functions")) * 0.10 + F.when(F.col("a.intent") == F.col("b.intent"), 0.05).otherwise(0.0) + F.greatest(F.lit(0.0), 1 - F.abs(x - y)) * 0.05


def logic() -> Column:
    return jaccard(*both("joins")) * 0.4 + jaccard(*both("filters")) * 0.3 + jaccard(*both("aggregations")) * 0.3


def stable_unit(c: Column) -> Column:
    """A number from 0 to 0.99 that depends on the text alone."""
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % 100 / 100.0


def structure_vector(row: str = "") -> Column:
    """26 numbers: hashes of up to ten tables and ten functions, complexity, intent, and four counts."""
    c = lambda f: F.col(f"{row}.{f}" if row else f)
    slots = lambda f: [F.coalesce(stable_unit(F.get(c(f), F.lit(i))), F.lit(0.0)) for i in range(10)]
    part = lambda f, n: F.least(F.lit(1.0), F.size(c(f)) / n)
    return F.array(*slots("tables"), *slots("functions"), F.least(F.lit(1.0), c("complexity") / 10), stable_unit(c("intent")), part("tables", 10.0), part("columns", 20.0), part("joins", 5.0), part("filters", 10.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def members(featured: DataFrame) -> DataFrame:
    """(query_id, sig): the signature of every query, the smallest id with the same features."""
    if "sql_text" not in featured.columns:
        key = F.to_json(F.struct(*FEATURES))
        return featured.select("query_id", key.alias("k")).join(featured.groupBy(key.alias("k")).agg(F.min("query_id").alias("sig")), "k").select("query_id", "sig")
    texts = featured.groupBy("sql_text").agg(F.min("query_id").alias("first"), F.any_value(F.to_json(F.struct(*FEATURES))).alias("k"))
    sigs = texts.groupBy("k").agg(F.min("first").alias("sig"))
    of = texts.join(sigs, "k").select(F.col("sql_text").alias("text"), "sig")
    return featured.select("query_id", "sql_text").join(of, F.col("sql_text").eqNullSafe(F.col("text"))).select("query_id", "sig")


def scored(sigs: DataFrame, limit: float = LIMIT, others: DataFrame | None = None) -> DataFrame:
    """Candidates with every dimension: basic, semantics, sources, logic, output, parameters and final.

    With others, pairs of a signature a of sigs and one b of others."""
    return _dimensioned(candidates(sigs.withColumn("vector", structure_vector()), limit, None if others is None else others.withColumn("vector", structure_vector())))


def within(sigs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The same for the pairs inside a signature: one row for each that has several queries, with itself; there are
    n (n - 1) / 2 pairs of them, all alike."""
    x = sigs.where("n > 1").withColumn("vector", structure_vector())
    p = x.select(F.struct("*").alias("a"), F.struct("*").alias("b"), compatibility(F.col("domains"), F.col("domains")).alias("compat")).where(F.col("compat") >= limit)
    return _dimensioned(p)


def pair_count() -> Column:
    """How many pairs of queries a pair of signatures stands for."""
    return F.when(F.col("a.sig") == F.col("b.sig"), (F.col("a.n") * (F.col("a.n") - 1) / 2).cast("long")).otherwise(F.col("a.n") * F.col("b.n"))


def _dimensioned(p: DataFrame) -> DataFrame:
    p = p.withColumn("basic", basic()).withColumn("semantics", cosine(F.col("a.vector"), F.col("b.vector"))).withColumn("logic", logic()).withColumn("output", jaccard(*both("columns"))).withColumn("parameters", F.lit(0.5))
    return p.withColumn("final", F.col("compat") * 0.50 + F.col("semantics") * 0.20 + F.col("logic") * 0.15 + F.col("output") * 0.10 + F.col("parameters") * 0.05)


DIMENSIONS = ("compat", "semantics", "logic", "output", "parameters")


def confidence(*dims: Column, high: float = 0.8, low: float = 0.3, values: tuple[float, float, float] = (0.95, 0.90, 0.75)) -> Column:
    """By how many of the scores are high or low."""
    some = F.array(*dims)
    return F.when(F.size(F.filter(some, lambda x: x > high)) >= 3, values[0]).when(F.size(F.filter(some, lambda x: x < low)) >= 3, values[1]).otherwise(values[2])


def gate(basic: Column, vector: Column) -> Column:
    """Kept in the vector stage: a good mean of both, or a very close vector."""
    return (basic * 0.4 + vector * 0.6 >= 0.5) | (vector >= 0.7)


def explanation() -> Column:
    common = F.array_sort(F.array_intersect(*both("tables")))
    return F.concat_ws(
        ". ", F.when(F.col("compat") > 0.8, F.concat(F.lit("Both read the same kind of data: "), F.concat_ws(", ", common))), F.when(F.col("logic") > 0.7, "Similar joins, filters and aggregations"), F.when(F.col("output") > 0.7, "Similar columns"),
        F.when(F.col("final") > 0.85, "Strong candidate for consolidation").when(F.col("final") > 0.5, "Moderate similarity, to be reviewed").otherwise("Low similarity"),
    )
