"""Pairs of the query log's signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators import pairs as P
from reportmill.plans.querylog import FEATURES, featured
from reportmill.plans.registry import query

SIGS = f"(SELECT {', '.join(P.FEATURES)}, min(query_id) AS sig, count(*) AS n, min(complexity) AS complexity, min(intent) AS intent, min(domains) AS domains, min(semantic_hash) AS semantic_hash, min(canonical) AS canonical, min(operations) AS operations, min(statement) AS statement FROM {FEATURES} GROUP BY ALL)"


def sql_jaccard(f: str) -> str:
    both = f"len(list_distinct(list_concat(a.{f}, b.{f})))"
    return f"(CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.{f}, b.{f})) / {both} END)"


_KIN = "least(x, y) || ' ' || greatest(x, y) IN ('customer sales', 'product sales', 'finance sales', 'customer finance', 'inventory product', 'general sales', 'customer general', 'general product', 'finance general')"
COMPAT = f"list_avg(flatten(list_transform(a.domains, lambda x: list_transform(b.domains, lambda y: CASE WHEN x = y THEN 1.0::DOUBLE WHEN {_KIN} THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END))))"


def _unit(x: str) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 4) AS BIGINT) % 100 / 100.0::DOUBLE)"


def sql_vector(r: str = "") -> str:
    slots = [f"coalesce({_unit(f'{r}{f}[{i}]')}, 0.0)" for f in ("tables", "functions") for i in range(1, 11)]
    part = [f"least(1.0::DOUBLE, len({r}{f}) / {n})" for f, n in (("tables", 10.0), ("columns", 20.0), ("joins", 5.0), ("filters", 10.0))]
    return f"[{', '.join(f'CAST({x} AS DOUBLE)' for x in (*slots, f'least(1.0::DOUBLE, {r}complexity / 10)', _unit(f'{r}intent'), *part))}]"


_VSIGS = f"(SELECT *, {sql_vector()} AS vector FROM {SIGS})"
CANDIDATES = f"(SELECT * FROM (SELECT a, b, {COMPAT} AS compat FROM {_VSIGS} a JOIN {_VSIGS} b ON a.sig < b.sig) WHERE compat >= 0.3)"
SCORED = f"""(SELECT *, compat * 0.50 + semantics * 0.20 + logic * 0.15 + output * 0.10 + 0.5 * 0.05 AS final FROM (SELECT *, list_cosine_similarity(a.vector, b.vector) AS semantics, {sql_jaccard('columns')} AS output,
{sql_jaccard('joins')} * 0.4 + {sql_jaccard('filters')} * 0.3 + {sql_jaccard('aggregations')} * 0.3 AS logic,
compat * 0.5 + {sql_jaccard('tables')} * 0.15 + {sql_jaccard('columns')} * 0.15 + {sql_jaccard('functions')} * 0.10 + CASE WHEN a.intent = b.intent THEN 0.05 ELSE 0.0 END + greatest(0.0, 1 - abs(a.complexity - b.complexity)) * 0.05 AS basic FROM {CANDIDATES}))"""
#: Pairs inside a signature: equal in every feature, so each score is that of equal lists.
WITHIN = f"""(SELECT *, compat * 0.50 + 0.20 + 0.15 + 0.10 + 0.5 * 0.05 AS final, compat * 0.5 + 0.5 AS basic, 1.0::DOUBLE AS semantics FROM (SELECT a.sig, a.n, CAST(a.n * (a.n - 1) / 2 AS BIGINT) AS pairs, {COMPAT} AS compat FROM {SIGS} a JOIN {SIGS} b ON a.sig = b.sig WHERE a.n > 1) WHERE compat >= 0.3)"""
IDS = "a.sig AS q1, b.sig AS q2"


def sigs(spark: SparkSession, d: str) -> DataFrame:
    return P.signatures(featured(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return P.scored(sigs(spark, d))


def every_pair(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of signatures, and the pairs inside each."""
    s = sigs(spark, d)
    return P.scored(s).unionByName(P.within(s))


@query(f"SELECT query_id, sig FROM {FEATURES} f JOIN {SIGS} g USING ({', '.join(P.FEATURES)})")
def signature_members(spark: SparkSession, d: str) -> DataFrame:
    """The signature of every query: with the pairs of signatures, all links of all queries."""
    return P.members(featured(spark, d))


@query(f"SELECT sig, n, pairs, round(compat, 6) AS sources, round(basic, 6) AS basic, round(final, 6) AS final FROM {WITHIN}")
def signature_pairs_within(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of several queries, with what each pair of their queries scores."""
    return P.within(sigs(spark, d)).select(F.col("a.sig").alias("sig"), F.col("a.n").alias("n"), P.pair_count().alias("pairs"), r("compat", "sources"), r("basic", "basic"), r("final", "final"))


def ids(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("a.sig").alias("q1"), F.col("b.sig").alias("q2"), *more)


def r(c, name: str, digits: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), digits).alias(name)


@query(f"SELECT {IDS}, CAST(a.n * b.n AS BIGINT) AS pairs, round(compat, 6) AS compat, a.semantic_hash = b.semantic_hash AS same_hash FROM {CANDIDATES}")
def pair_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ids(P.candidates(sigs(spark, d)), (F.col("a.n") * F.col("b.n")).alias("pairs"), r("compat", "compat"), (F.col("a.semantic_hash") == F.col("b.semantic_hash")).alias("same_hash"))


_DOMS = f"(SELECT DISTINCT domains FROM {SIGS})"


@query(f"SELECT array_to_string(a.domains, ',') AS d1, array_to_string(b.domains, ',') AS d2, round({COMPAT}, 6) AS compat FROM {_DOMS} a, {_DOMS} b WHERE {COMPAT} >= 0.3")
def domain_compatibility(spark: SparkSession, d: str) -> DataFrame:
    return P.domain_pairs(sigs(spark, d)).select(F.concat_ws(",", "d1").alias("d1"), F.concat_ws(",", "d2").alias("d2"), r("compat", "compat"))


@query(f"SELECT {IDS}, round({sql_jaccard('tables')}, 6) AS tables, round({sql_jaccard('columns')}, 6) AS columns, round({sql_jaccard('joins')}, 6) AS joins FROM {CANDIDATES}")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ids(P.candidates(sigs(spark, d)), *(r(P.jaccard(*P.both(f)), f) for f in ("tables", "columns", "joins")))


@query(f"SELECT {IDS}, round(basic, 6) AS basic FROM {SCORED}")
def query_pair_basic(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d), r("basic", "basic"))


@query(f"SELECT {IDS}, round(logic, 6) AS logic FROM {SCORED}")
def query_pair_logic(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d), r("logic", "logic"))


FINAL = f"SELECT {IDS}, round(compat, 6) AS sources, round(semantics, 6) AS semantics, round(logic, 6) AS logic, round(output, 6) AS output, round(final, 6) AS final FROM {SCORED}"


@query(FINAL)
def query_pair_final(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d), r("compat", "sources"), r("semantics", "semantics"), r("logic", "logic"), r("output", "output"), r("final", "final"))


@query(f"{FINAL} ORDER BY final DESC, q1, q2")
def rank_pairs(spark: SparkSession, d: str) -> DataFrame:
    return query_pair_final(spark, d).orderBy(F.desc("final"), "q1", "q2")


_COMPLEX = "1 - abs(a.complexity - b.complexity) / greatest(a.complexity, b.complexity, 1.0)"


@query(f"""SELECT *, round((table_similarity + column_similarity + function_similarity + operation_similarity + join_similarity + intent_similarity + type_similarity + complexity_similarity + canonical_similarity + semantic_similarity) / 10, 3) AS mean FROM (
SELECT {IDS}, round({sql_jaccard('tables')}, 6) AS table_similarity, round({sql_jaccard('columns')}, 6) AS column_similarity, round({sql_jaccard('functions')}, 6) AS function_similarity, round({sql_jaccard('operations')}, 6) AS operation_similarity, round({sql_jaccard('joins')}, 6) AS join_similarity,
CAST(a.intent = b.intent AS DOUBLE) AS intent_similarity, CAST(a.statement = b.statement AS DOUBLE) AS type_similarity, round({_COMPLEX}, 6) AS complexity_similarity, CAST(a.canonical = b.canonical AS DOUBLE) AS canonical_similarity, CAST(a.semantic_hash = b.semantic_hash AS DOUBLE) AS semantic_similarity FROM {CANDIDATES})""")
def query_pair_features(spark: SparkSession, d: str) -> DataFrame:
    same = lambda f: (F.col(f"a.{f}") == F.col(f"b.{f}")).cast("double")
    x, y = P.both("complexity")
    each = {"table_similarity": P.jaccard(*P.both("tables")), "column_similarity": P.jaccard(*P.both("columns")), "function_similarity": P.jaccard(*P.both("functions")), "operation_similarity": P.jaccard(*P.both("operations")), "join_similarity": P.jaccard(*P.both("joins")),
            "intent_similarity": same("intent"), "type_similarity": same("statement"), "complexity_similarity": 1 - F.abs(x - y) / F.greatest(x, y, F.lit(1.0)), "canonical_similarity": same("canonical"), "semantic_similarity": same("semantic_hash")}
    t = ids(P.candidates(sigs(spark, d)), *(r(v, k) for k, v in each.items()))
    return t.select("*", r(sum((F.col(k) for k in each), F.lit(0.0)) / 10, "mean", 3))


def sql_diff(f: str) -> str:
    out = lambda x, y: f"coalesce(array_to_string(list_filter({x}.{f}, lambda v: NOT list_contains({y}.{f}, v)), ','), '')"
    return f"{out('a', 'b')} AS left_{f}, {out('b', 'a')} AS right_{f}, coalesce(array_to_string(list_filter(a.{f}, lambda v: list_contains(b.{f}, v)), ','), '') AS common_{f}"


@query(f"SELECT {IDS}, {', '.join(map(sql_diff, ('tables', 'columns', 'functions')))} FROM {CANDIDATES}")
def query_feature_diff(spark: SparkSession, d: str) -> DataFrame:
    cols = []
    for f in ("tables", "columns", "functions"):
        a, b = P.both(f)
        cols += [F.concat_ws(",", F.array_except(a, b)).alias(f"left_{f}"), F.concat_ws(",", F.array_except(b, a)).alias(f"right_{f}"), F.concat_ws(",", F.array_intersect(a, b)).alias(f"common_{f}")]
    return ids(P.candidates(sigs(spark, d)), *cols)


@query(f"""SELECT {IDS}, concat_ws('. ', CASE WHEN compat > 0.8 THEN 'Both read the same kind of data: ' || coalesce(array_to_string(list_sort(list_intersect(a.tables, b.tables)), ', '), '') END, CASE WHEN logic > 0.7 THEN 'Similar joins, filters and aggregations' END,
CASE WHEN output > 0.7 THEN 'Similar columns' END, CASE WHEN final > 0.85 THEN 'Strong candidate for consolidation' WHEN final > 0.5 THEN 'Moderate similarity, to be reviewed' ELSE 'Low similarity' END) AS words FROM {SCORED}""")
def explain_pair(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d), P.explanation().alias("words"))


_DIMS = "[compat, semantics, logic, output, 0.5]"


@query(f"SELECT {IDS}, CAST(CASE WHEN len(list_filter({_DIMS}, lambda v: v > 0.8)) >= 3 THEN 0.95 WHEN len(list_filter({_DIMS}, lambda v: v < 0.3)) >= 3 THEN 0.90 ELSE 0.75 END AS DOUBLE) AS confidence FROM {SCORED}")
def pair_confidence_query(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d), P.confidence(*map(F.col, P.DIMENSIONS)).alias("confidence"))


@query(f"SELECT {IDS}, round(basic, 6) AS basic, round(semantics, 6) AS vector FROM {SCORED} WHERE basic * 0.4 + semantics * 0.6 >= 0.5 OR semantics >= 0.7")
def embedding_gate(spark: SparkSession, d: str) -> DataFrame:
    return ids(scored(spark, d).where(P.gate(F.col("basic"), F.col("semantics"))), r("basic", "basic"), r("semantics", "vector"))


_KEPT = "basic >= 0.4 AND (basic * 0.4 + semantics * 0.6 >= 0.5 OR semantics >= 0.7)"
_EVERY = f"(SELECT CAST(a.n * b.n AS BIGINT) AS pairs, basic, semantics FROM {SCORED} UNION ALL SELECT pairs, basic, semantics FROM {WITHIN})"


@query(f"SELECT CAST(sum(pairs) AS BIGINT) AS compatible, CAST(sum(pairs) FILTER (basic >= 0.4) AS BIGINT) AS structural, CAST(sum(pairs) FILTER ({_KEPT}) AS BIGINT) AS by_vector, round(100.0 * sum(pairs) FILTER ({_KEPT}) / sum(pairs), 4) AS kept_share FROM {_EVERY}")
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    n, first = P.pair_count(), F.col("basic") >= 0.4
    second = first & P.gate(F.col("basic"), F.col("semantics"))
    every, kept = F.sum(n), F.sum(F.when(second, n))
    return every_pair(spark, d).agg(every.alias("compatible"), F.sum(F.when(first, n)).alias("structural"), kept.alias("by_vector"), F.round(kept * 100.0 / every, 4).alias("kept_share"))


@query(f"SELECT CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(pairs) * 50 AS BIGINT) AS tokens, round(sum(pairs) * 50 * 0.002 / 1000, 6) AS cost FROM {_EVERY} WHERE {_KEPT}")
def token_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(P.pair_count())
    kept = every_pair(spark, d).where((F.col("basic") >= 0.4) & P.gate(F.col("basic"), F.col("semantics")))
    return kept.agg(n.alias("pairs"), (n * 50).alias("tokens"), F.round(n * 50 * 0.002 / 1000, 6).alias("cost"))


@query(f"SELECT sig, array_to_string(list_transform({sql_vector()}, lambda v: CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR)), ' ') AS vector FROM {SIGS}")
def structure_vector(spark: SparkSession, d: str) -> DataFrame:
    return sigs(spark, d).select("sig", F.concat_ws(" ", F.transform(P.structure_vector(), lambda v: F.round(v * 10000).cast("long").cast("string"))).alias("vector"))
