"""Features and dialects of the query log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import dialects as D
from reportmill.functions import features as X
from reportmill.functions import rules as R
from reportmill.operators.shared import cut, store
from reportmill.plans.registry import query
from reportmill.plans.rules import STATEMENT, Q, quoted, sql_any, sql_cases, sql_table_domain
from reportmill.sources.corpus import load, oracle


# Patterns and word lists, as the SQL has them.
_TABLE = r"'(?i)\b(?:FROM|JOIN|INTO)\s+([A-Za-z_][\w.]*)'"
_JOIN = r"'\b(INNER|LEFT|RIGHT|FULL|CROSS)(?:\s+OUTER)?\s+JOIN\b'"
_WHERE = r"'(?i)\bWHERE\s+(.*?)(?:\s+GROUP\s+BY\b|\s+ORDER\s+BY\b|\s+LIMIT\b|\s+HAVING\b|$)'"
_OPERATOR = r"'(<=|>=|<>|!=|=|<|>|\bLIKE\b|\bIN\b|\bBETWEEN\b)'"
_OPERATION = r"'\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b'"
_CALL = r"'\b(SUM|COUNT|AVG|MAX|MIN|DISTINCT|CAST|CONVERT|ISNULL|COALESCE|CASE|DATEADD|DATEDIFF|GETDATE|YEAR|MONTH|DAY|SUBSTRING|LEN|LTRIM|RTRIM|UPPER|LOWER|ROW_NUMBER|RANK|DENSE_RANK)\s*\('"
_NO_COLUMNS = """['select', 'from', 'where', 'group', 'by', 'order', 'having', 'join', 'inner', 'left', 'right', 'full', 'outer', 'cross', 'on', 'as', 'and', 'or', 'not', 'in', 'like', 'between', 'is', 'null', 'case', 'when', 'then', 'else', 'end', 'union', 'all', 'distinct', 'top', 'limit', 'offset', 'asc', 'desc',
'insert', 'into', 'update', 'delete', 'set', 'values', 'with', 'exists', 'extract', 'nvl', 'ifnull', 'over', 'partition', 'text', 'sum', 'count', 'avg', 'max', 'min', 'cast', 'convert', 'isnull', 'coalesce', 'dateadd', 'datediff', 'getdate', 'year', 'month', 'day', 'substring', 'len', 'ltrim', 'rtrim', 'upper', 'lower',
'row_number', 'rank', 'dense_rank']"""
_AGGREGATES = "['SUM', 'COUNT', 'AVG', 'MAX', 'MIN']"


def _found(text: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, {pattern}, 1)))"


def _text(column: str) -> str:
    return f"array_to_string({column}, ' ')"


def sql_joined(column: str) -> str:
    return f"coalesce(array_to_string({column}, ','), '')"


#: The features as a chain of subqueries.
CLEAN = rf"SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(sql_text, '--[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS clean FROM {Q}"
BARE = rf"""SELECT *, regexp_replace(regexp_replace(clean, '[`"\[\]]', '', 'g'), '(?i)\bEXTRACT\s*\([^)]*\)', 'EXTRACT()', 'g') AS bare FROM ({CLEAN})"""
LISTS = rf"""SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(bare, {_TABLE}, 1), lambda x: lower(x)))) AS tables, {_found('upper(bare)', _CALL)} AS functions, {_found('upper(bare)', _JOIN)} AS joins,
regexp_extract(bare, {_WHERE}, 1) AS body, regexp_matches(upper(bare), '\bGROUP\s+BY\b') AS grouped, regexp_matches(upper(bare), '\bORDER\s+BY\b') AS sorted,
list_concat(regexp_extract_all(clean, '(@\w+|\$\w+|\?)', 1), list_transform(regexp_extract_all(clean, '[^:\w]:([A-Za-z_]\w*)', 1), lambda x: ':' || x)) AS every_parameter,
regexp_extract_all(lower(regexp_replace(regexp_replace(bare, '''[^'']*''', '', 'g'), '[@:$]+\w+', '', 'g')), '([a-z_][a-z0-9_.]*)', 1) AS names FROM ({BARE})"""
_KIND = STATEMENT.replace("(q)", "(clean)").replace("(q,", "(clean,")
MORE = rf"""SELECT *, {_found('upper(bare)', _OPERATION)} AS operations, {_KIND} AS statement, list_filter(every_parameter, lambda x, i: list_position(every_parameter, x) = i) AS parameters, {_found('upper(body)', _OPERATOR)} AS filters,
list_sort(list_distinct(list_filter(list_transform(list_filter(names, lambda x: NOT list_contains(tables, x)), lambda x: regexp_replace(x, '^.*\.', '')), lambda x: length(x) > 1 AND NOT list_contains({_NO_COLUMNS}, x)))) AS columns,
list_concat(list_filter(functions, lambda x: list_contains({_AGGREGATES}, x)), list_concat(CASE WHEN grouped THEN ['GROUP BY'] ELSE [] END, CASE WHEN regexp_matches(upper(bare), '\bHAVING\b') THEN ['HAVING'] ELSE [] END)) AS aggregations FROM ({LISTS})"""
_SALES = sql_any(f"({_text('tables')} || ' ' || {_text('columns')})", ("customer", "order", "sale", "product"))
_BOTH = f"({_text('tables')} || ' ' || {_text('columns')})"
_SUMMED = "list_has_any(aggregations, ['SUM', 'COUNT', 'AVG'])"
FEATURES = rf"""(SELECT *, round(complexity + CASE WHEN grouped THEN 2.0 ELSE 0.0 END + CASE WHEN sorted THEN 1.0 ELSE 0.0 END, 4) AS complexity_plus, md5({" || '|' || ".join(sql_joined(c) for c in ("tables", "columns", "functions", "joins", "filters"))}) AS semantic_hash,
'SELECT ' || {sql_joined('columns')} || ' FROM ' || {sql_joined('tables')} || CASE WHEN len(aggregations) > 0 THEN ' AGG ' || {sql_joined('aggregations')} ELSE '' END AS canonical,
regexp_replace(regexp_replace(clean, '\Q' || coalesce(parameters[1], chr(1)) || '\E\b', '@PARAM1', 'g'), '\Q' || coalesce(parameters[2], chr(1)) || '\E\b', '@PARAM2', 'g') AS parameterized FROM (
SELECT *, CAST(round(len(tables) * 1.0 + len(columns) * 0.1 + len(functions) * 0.5 + len(joins) * 2.0 + len(filters) * 0.3 + len(aggregations) * 1.5, 4) AS DOUBLE) AS complexity,
list_sort(list_transform(tables, lambda t: {sql_table_domain('t')})) AS domains,
{sql_cases([(f"{_SUMMED} AND list_contains(aggregations, 'GROUP BY')", "'analytical_summary'"), (_SUMMED, "'aggregated_reporting'"), ("len(tables) > 3", "'complex_analytical'"), (sql_any(_text('columns'), ('date', 'time', 'created', 'updated')), "'temporal_analysis'"), (sql_any(_text('tables'), ('customer', 'order', 'sale', 'product')), "'business_operations'")], "'general_reporting'")} AS intent,
{sql_cases([(f"{_SALES} AND len(aggregations) > 0 AND grouped", "'sales_analytics'"), (_SALES, "'sales_operations'"), (sql_any(_BOTH, ('employee', 'staff', 'department', 'salary')), "'hr_analytics'"), (sql_any(_BOTH, ('inventory', 'stock', 'warehouse', 'item')), "'inventory_management'"), ("len(aggregations) > 0 AND grouped", "'analytical_reporting'"), ("len(aggregations) > 0", "'summary_reporting'"), ("len(tables) > 3", "'complex_operational'"), ("sorted", "'listing_report'")], "'general_query'")} AS intent_domain
FROM ({MORE})))"""


def by_text(queries: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """queries with the columns that f adds to their texts, (sql_text). Each distinct text is looked at once, in tasks that the
    texts are shuffled to, however few files the queries come from; texts that very many queries have stay in one row there."""
    texts = cut(f(queries.select("sql_text").distinct().repartition(F.xxhash64("sql_text")))).withColumnRenamed("sql_text", "_text")
    return queries.join(texts, F.col("sql_text").eqNullSafe(F.col("_text"))).drop("_text")


def featured(spark: SparkSession, d: str) -> DataFrame:
    return by_text(load(spark, d, "report_query"), X.with_features)


def _one(key: str, columns: dict[str, bool]) -> None:
    """Registers a query that shows some features; True marks a list."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        return featured(spark, d).select("query_id", *(F.concat_ws(",", c).alias(c) if many else F.col(c) for c, many in columns.items()))
    shown = ", ".join(f"{sql_joined(c)} AS {c}" if many else c for c, many in columns.items())
    query(f"SELECT query_id, {shown} FROM {FEATURES}", key)(run)


for _key, _columns in {
    "strip_comments": {"clean": False}, "tables_used": {"tables": True}, "columns_used": {"columns": True}, "functions_used": {"functions": True}, "joins_used": {"joins": True}, "filter_operators": {"filters": True},
    "aggregations_used": {"aggregations": True}, "grouping_sorting_flags": {"grouped": False, "sorted": False}, "parameters_used": {"parameters": True}, "parameterize": {"parameterized": False}, "canonical_form": {"canonical": False},
    "semantic_hash": {"semantic_hash": False}, "query_intent_simple": {"intent": False}, "query_intent_domain": {"intent_domain": False}, "query_complexity": {"complexity": False}, "query_complexity_plus": {"complexity_plus": False},
    "features_all": {"tables": True, "columns": True, "functions": True, "joins": True, "filters": True, "aggregations": True, "parameters": True, "domains": True, "complexity": False, "intent": False, "semantic_hash": False},
}.items():
    _one(_key, _columns)

BODIES = r"(SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'x BETWEEN 1 AND 5 AND ' || body ELSE body || ' AND y = 2' END AS b FROM (SELECT *, regexp_extract(bare, " + _WHERE + f", 1) AS body FROM ({BARE})) WHERE body <> '')"


@query(rf"""SELECT query_id, CAST(i - 1 AS INT) AS position, replace(p[i], '~AND~', 'AND') AS condition FROM (SELECT query_id, p, unnest(range(1, len(p) + 1)) AS i FROM
(SELECT query_id, list_filter(regexp_split_to_array(regexp_replace(b, '(?i)(\bBETWEEN\s+\S+)\s+AND\s', '\1 ~AND~ ', 'g'), '(?i)\s+AND\s+'), lambda x: x <> '') AS p FROM {BODIES}))""")
def where_conditions(spark: SparkSession, d: str) -> DataFrame:
    t = featured(spark, d).withColumn("body", X.where_body(F.col("bare"))).where("body <> ''")
    t = t.select("query_id", F.concat(F.lit("SELECT 1 FROM t WHERE "), F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("x BETWEEN 1 AND 5 AND "), "body")).otherwise(F.concat("body", F.lit(" AND y = 2")))).alias("b"))
    return t.select("query_id", F.posexplode(X.conditions(F.col("b"))).alias("position", "condition"))


@query(f"SELECT query_id, CASE WHEN contains(upper(sql_text), 'JOIN') THEN 2 ELSE 0 END + CASE WHEN contains(upper(sql_text), 'UNION') THEN 3 ELSE 0 END + CASE WHEN contains(sql_text, '(') THEN 2 ELSE 0 END + CASE WHEN contains(upper(sql_text), 'CASE') THEN 1 ELSE 0 END + CAST(len(parameters) + len(filters) + 2 * coalesce(calculated, 0) AS INT) AS score FROM {FEATURES} LEFT JOIN (SELECT query_id, count(*) AS calculated FROM {oracle('dataset_field')} WHERE expression IS NOT NULL GROUP BY 1) USING (query_id)")
def dataset_complexity(spark: SparkSession, d: str) -> DataFrame:
    u = F.upper("sql_text")
    plain = sum((F.when(u.contains(w), n).otherwise(0) for w, n in (("JOIN", 2), ("UNION", 3), ("(", 2), ("CASE", 1))), F.lit(0))
    fields = load(spark, d, "dataset_field").where("expression IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("calculated"))
    scored = featured(spark, d).select("query_id", (plain + F.size("parameters") + F.size("filters")).alias("plain")).join(fields, "query_id", "left")
    return scored.select("query_id", (F.col("plain") + F.coalesce("calculated", F.lit(0)) * 2).alias("score"))


SCORE = {k: "(" + " + ".join(f"CASE WHEN regexp_matches(upper(sql_text), {quoted(p)}) THEN {w} ELSE 0 END" for w, p, _ in v) + ")" for k, v in D.SIGNS.items()}
SCORED = f"(SELECT query_id, sql_text, {', '.join(f'{v} AS s{i}' for i, v in enumerate(SCORE.values()))} FROM {Q})"
_BEST = f"greatest({', '.join(f's{i}' for i in range(len(SCORE)))})"
_DIALECT = sql_cases([(f"{_BEST} = 0", "'ANSI SQL'"), *((f"s{i} = {_BEST}", f"'{k}'") for i, k in enumerate(SCORE))], "''")
DETECTED = f"""(SELECT query_id, dialect, CAST(round(least(1.0, coalesce(best / nullif(total, 0), 0) * CASE WHEN {" OR ".join(f"(dialect = '{k}' AND regexp_matches(upper(sql_text), {quoted(p)}))" for k, p in D.STRONG.items())} THEN 1.2 ELSE 1.0 END), 6) AS DOUBLE) AS confidence
FROM (SELECT *, {_DIALECT} AS dialect, {_BEST} AS best, {' + '.join(f's{i}' for i in range(len(SCORE)))} AS total FROM {SCORED}))"""


def _name(dialect: str) -> str:
    return dialect.lower().replace("-", "").replace("/", "")


@query(f"SELECT query_id, {', '.join(f's{i} AS {_name(k)}' for i, k in enumerate(SCORE))} FROM {SCORED}")
def dialect_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = {_name(k): v for k, v in D.scores(F.col("sql_text")).items()}
    return by_text(load(spark, d, "report_query"), lambda t: t.select("sql_text", *(v.alias(k) for k, v in scores.items()))).select("query_id", *scores)


@query(f"SELECT * FROM {DETECTED}")
def dialect_detect(spark: SparkSession, d: str) -> DataFrame:
    return D.detected(load(spark, d, "report_query")).select("query_id", "dialect", "confidence")


_QUICK = """CASE WHEN contains(u, 'DECLARE @') OR contains(u, 'SET @') OR contains(u, 'EXEC ') OR contains(u, 'EXECUTE ') OR contains(u, '@@') THEN 'T-SQL' WHEN contains(u, 'DECLARE') OR contains(u, 'BEGIN') OR contains(u, 'END;') OR contains(u, 'EXCEPTION') OR contains(u, 'CURSOR') THEN 'PL/SQL'
WHEN contains(u, '$1') OR contains(u, '$2') OR contains(u, 'RETURNING') OR contains(u, '::') THEN 'PostgreSQL' WHEN contains(u, 'DUAL') OR contains(u, 'ROWNUM') OR contains(u, 'CONNECT BY') THEN 'Oracle' WHEN contains(u, 'LIMIT') OR contains(u, '`') OR contains(u, 'IFNULL') THEN 'MySQL' ELSE 'Standard SQL' END"""


@query(f"SELECT query_id, {_QUICK} AS dialect FROM (SELECT query_id, upper(sql_text) AS u FROM {Q})")
def dialect_detect_quick(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_query").select("query_id", D.quick(F.col("sql_text")).alias("dialect"))


_SIGNS = ", ".join(f"CASE WHEN regexp_matches(upper(sql_text), {quoted(p)}) THEN {quoted(f'{k} {n}')} END" for k, v in D.SIGNS.items() for _, p, n in v)


@query(f"SELECT query_id, array_to_string(list_filter([{_SIGNS}], lambda x: x IS NOT NULL), ',') AS signs FROM {Q}")
def dialect_features(spark: SparkSession, d: str) -> DataFrame:
    return by_text(load(spark, d, "report_query"), lambda t: t.select("sql_text", F.concat_ws(",", D.signs(F.col("sql_text"))).alias("signs"))).select("query_id", "signs")


#: One spelling for functions of several dialects, as the SQL has them.
_SPELLED = (("ISNULL", "COALESCE"), ("NVL", "COALESCE"), ("IFNULL", "COALESCE"), ("GETDATE", "CURRENT_TIMESTAMP"), ("NOW", "CURRENT_TIMESTAMP"), ("DATEDIFF", "DATE_DIFF"), ("DATEADD", "DATE_ADD"), ("LEN", "LENGTH"))


def _normal() -> str:
    out = r"""regexp_replace(regexp_replace(sql_text, '\[([^\]]+)\]', '"\1"', 'g'), '`([^`]+)`', '"\1"', 'g')"""
    for a, b in _SPELLED:
        out = rf"regexp_replace({out}, '(?i)\b{a}\s*\(', '{b}(', 'g')"
    return rf"regexp_replace({out}, '(?i)\bTOP\s+(\d+)\b', 'LIMIT \1', 'g')"


_NOTES = ", ".join([r"CASE WHEN regexp_matches(sql_text, '\[[^\]]+\]') THEN 'brackets' END", "CASE WHEN regexp_matches(sql_text, '`[^`]+`') THEN 'backticks' END", *(rf"CASE WHEN regexp_matches(sql_text, '(?i)\b{a}\s*\(') THEN '{a} to {b}' END" for a, b in _SPELLED), r"CASE WHEN regexp_matches(sql_text, '(?i)\bTOP\s+\d+\b') THEN 'TOP to LIMIT' END"])


@query(f"SELECT query_id, {_normal()} AS normal, array_to_string(list_filter([{_NOTES}], lambda x: x IS NOT NULL), ',') AS notes FROM {Q}")
def dialect_normalize(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("sql_text")
    return load(spark, d, "report_query").select("query_id", D.normalize(q).alias("normal"), F.concat_ws(",", D.notes(q)).alias("notes"))


@query(f"SELECT dialect, count(*) AS n, round(avg(confidence), 6) AS confidence FROM {DETECTED} GROUP BY dialect")
def dialect_profile(spark: SparkSession, d: str) -> DataFrame:
    return dialect_detect(spark, d).groupBy("dialect").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"SELECT x.dialect, f.intent_domain AS domain, count(*) AS n FROM {DETECTED} x JOIN {FEATURES} f USING (query_id) GROUP BY CUBE (x.dialect, f.intent_domain)")
def reports_rollup(spark: SparkSession, d: str) -> DataFrame:
    return D.detected(featured(spark, d)).select("dialect", F.col("intent_domain").alias("domain")).cube("dialect", "domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(tables) AS t FROM {FEATURES})) AS tables, (SELECT count(DISTINCT t) FROM (SELECT unnest(columns) AS t FROM {FEATURES})) AS columns, (SELECT count(DISTINCT semantic_hash) FROM {FEATURES}) AS signatures")
def feature_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    f = featured(spark, d)
    every = f.select(F.explode(F.concat(F.transform("tables", lambda x: F.struct(F.lit("t").alias("k"), x.alias("v"))), F.transform("columns", lambda x: F.struct(F.lit("c").alias("k"), x.alias("v"))), F.array(F.struct(F.lit("s").alias("k"), F.col("semantic_hash").alias("v"))))).alias("e")).distinct()
    return every.agg(F.count_if(F.col("e.k") == "t").alias("tables"), F.count_if(F.col("e.k") == "c").alias("columns"), F.count_if(F.col("e.k") == "s").alias("signatures"))


#: Bits of a sketch's size; its standard error is 1.04 / sqrt(2 ** bits).
SKETCH = 12


def sketches(featured: DataFrame, by: str) -> DataFrame:
    """(by, kind, sketch): a mergeable sketch of the distinct tables, columns and signatures of every group."""
    f = featured.select(by, F.explode(F.array(F.struct(F.lit("tables").alias("kind"), F.col("tables").alias("v")), F.struct(F.lit("columns").alias("kind"), F.col("columns").alias("v")), F.struct(F.lit("signatures").alias("kind"), F.array("semantic_hash").alias("v")))).alias("e"))
    return f.select(by, "e.kind", F.explode("e.v").alias("v")).groupBy(by, "kind").agg(F.hll_sketch_agg("v", F.lit(SKETCH)).alias("sketch"))


def united(kept: DataFrame) -> DataFrame:
    """One row of estimates from the sketches of any groups."""
    each = kept.groupBy("kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    return each.agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("tables", "columns", "signatures")))


@query()
def feature_distinct_approx(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of every report are kept as a table, and united; new reports only add rows to it."""
    return united(store(sketches(featured(spark, d), "report_id")))
