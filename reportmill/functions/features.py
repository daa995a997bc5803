"""Features of a query text, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import rules

# Functions that count as such, and words that are no columns.
FUNCTIONS = "SUM COUNT AVG MAX MIN DISTINCT CAST CONVERT ISNULL COALESCE CASE DATEADD DATEDIFF GETDATE YEAR MONTH DAY SUBSTRING LEN LTRIM RTRIM UPPER LOWER ROW_NUMBER RANK DENSE_RANK".split()
AGGREGATES = FUNCTIONS[:5]
KEYWORDS = (
    "select from where group by order having join inner left right full outer cross on as and or not in like between is null case when then else end union all distinct top limit offset asc desc "
    "insert into update delete set values with exists extract nvl ifnull over partition text"
).split() + [f.lower() for f in FUNCTIONS]
TABLE = r"(?i)\b(?:FROM|JOIN|INTO)\s+([A-Za-z_][\w.]*)"
JOIN = r"\b(INNER|LEFT|RIGHT|FULL|CROSS)(?:\s+OUTER)?\s+JOIN\b"
WHERE = r"(?i)\bWHERE\s+(.*?)(?:\s+GROUP\s+BY\b|\s+ORDER\s+BY\b|\s+LIMIT\b|\s+HAVING\b|$)"
OPERATOR = r"(<=|>=|<>|!=|=|<|>|\bLIKE\b|\bIN\b|\bBETWEEN\b)"
OPERATION = r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"
CALL = r"\b(" + "|".join(FUNCTIONS) + r")\s*\("


def strip_comments(sql: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def unquoted(clean: Column) -> Column:
    """Without the quotes of identifiers, and with EXTRACT(... FROM ...) emptied, whose FROM names no table."""
    return F.regexp_replace(F.regexp_replace(clean, r'[`"\[\]]', ""), r"(?i)\bEXTRACT\s*\([^)]*\)", "EXTRACT()")


def _all(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))


def parameters(clean: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(clean, F.lit(r"(@\w+|\$\w+|\?)"), 1), F.transform(F.regexp_extract_all(clean, F.lit(r"[^:\w]:([A-Za-z_]\w*)"), 1), lambda p: F.concat(F.lit(":"), p))))


def where_body(bare: Column) -> Column:
    return F.regexp_extract(bare, WHERE, 1)


def conditions(bare: Column) -> Column:
    """WHERE parts between ANDs; the AND of a BETWEEN does not part."""
    kept = F.regexp_replace(where_body(bare), r"(?i)(\bBETWEEN\s+\S+)\s+AND\s", "$1 ~AND~ ")
    return F.filter(F.transform(F.split(kept, r"(?i)\s+AND\s+"), lambda c: F.replace(c, F.lit("~AND~"), F.lit("AND"))), lambda c: c != "")


def with_features(df: DataFrame, sql: str = "sql_text") -> DataFrame:
    """df with all features of its query text; a null text has empty lists."""
    t = df.withColumn("clean", strip_comments(F.coalesce(F.col(sql), F.lit(""))))
    t = t.withColumn("bare", unquoted(F.col("clean"))).withColumn("upper_bare", F.upper("bare"))
    t = t.withColumn("tables", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("bare", F.lit(TABLE), 1), lambda x: F.lower(x)))))
    names = F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace("bare", "'[^']*'", ""), r"[@:$]+\w+", "")), F.lit(r"([a-z_][a-z0-9_.]*)"), 1)
    tails = F.transform(F.array_except(names, F.col("tables")), lambda x: F.regexp_replace(x, r"^.*\.", ""))
    t = t.withColumn("columns", F.array_sort(F.array_distinct(F.filter(F.array_except(tails, F.array(*map(F.lit, KEYWORDS))), lambda x: F.length(x) > 1))))
    t = t.withColumn("functions", _all(F.col("upper_bare"), CALL)).withColumn("joins", _all(F.col("upper_bare"), JOIN)).withColumn("filters", _all(F.upper(where_body(F.col("bare"))), OPERATOR))
    t = t.withColumn("grouped", F.col("upper_bare").rlike(r"\bGROUP\s+BY\b")).withColumn("sorted", F.col("upper_bare").rlike(r"\bORDER\s+BY\b"))
    marks = F.array_compact(F.array(F.when(F.col("grouped"), "GROUP BY"), F.when(F.col("upper_bare").rlike(r"\bHAVING\b"), "HAVING")))
    t = t.withColumn("aggregations", F.concat(F.array_intersect("functions", F.array(*map(F.lit, AGGREGATES))), marks)).withColumn("parameters", parameters(F.col("clean")))
    t = t.withColumn("complexity", F.round(F.size("tables") * 1.0 + F.size("columns") * 0.1 + F.size("functions") * 0.5 + F.size("joins") * 2.0 + F.size("filters") * 0.3 + F.size("aggregations") * 1.5, 4))
    t = t.withColumn("complexity_plus", F.round(F.col("complexity") + F.when(F.col("grouped"), 2.0).otherwise(0.0) + F.when(F.col("sorted"), 1.0).otherwise(0.0), 4))
    t = t.withColumn("operations", _all(F.col("upper_bare"), OPERATION)).withColumn("statement", rules.statement_type(F.col("clean")))
    t = t.withColumn("domains", F.array_sort(F.transform("tables", rules.table_domain)))
    t = t.withColumn("intent", intent(t)).withColumn("intent_domain", intent_domain(t))
    t = t.withColumn("canonical", F.concat(F.lit("SELECT "), F.concat_ws(",", "columns"), F.lit(" FROM "), F.concat_ws(",", "tables"), F.when(F.size("aggregations") > 0, F.concat(F.lit(" AGG "), F.concat_ws(",", "aggregations"))).otherwise("")))
    key = F.concat_ws("|", *(F.concat_ws(",", c) for c in ("tables", "columns", "functions", "joins", "filters")))
    return t.withColumn("semantic_hash", F.md5(key)).withColumn("parameterized", parameterized(F.col("clean"), F.col("parameters")))


def parameterized(clean: Column, params: Column) -> Column:
    """clean with its parameters named @PARAM1, @PARAM2 ... in the order of params. A name is replaced where it ends as a word,
    so @p leaves @p2 alone; new names are marked until all are in, so none is replaced twice."""
    mark = "\u0001"
    start = F.struct(clean.alias("s"), F.lit(1).alias("n"))
    one = lambda p: F.concat(F.lit("\\Q"), p, F.when(p == "?", "\\E").otherwise("\\E(?!\\w)"))
    step = lambda a, p: F.struct(F.regexp_replace(a["s"], one(p), F.concat(F.lit(mark + "PARAM"), a["n"].cast("string"))).alias("s"), (a["n"] + 1).alias("n"))
    return F.replace(F.aggregate(params, start, step, lambda a: a["s"]), F.lit(mark), F.lit("@"))


def intent(t: DataFrame) -> Column:
    columns, tables = F.concat_ws(" ", "columns"), F.concat_ws(" ", "tables")
    summed = F.arrays_overlap("aggregations", F.array(*map(F.lit, ("SUM", "COUNT", "AVG"))))
    return rules.cases([(summed & F.array_contains("aggregations", "GROUP BY"), "analytical_summary"), (summed, "aggregated_reporting"), (F.size("tables") > 3, "complex_analytical"), (rules.contains_any(columns, ("date", "time", "created", "updated")), "temporal_analysis"), (rules.contains_any(tables, ("customer", "order", "sale", "product")), "business_operations")], "general_reporting")


def intent_domain(t: DataFrame) -> Column:
    text, agg = F.concat_ws(" ", "tables", "columns"), F.size("aggregations") > 0
    sales = rules.contains_any(text, ("customer", "order", "sale", "product"))
    return rules.cases([(sales & agg & F.col("grouped"), "sales_analytics"), (sales, "sales_operations"), (rules.contains_any(text, ("employee", "staff", "department", "salary")), "hr_analytics"), (rules.contains_any(text, ("inventory", "stock", "warehouse", "item")), "inventory_management"),
                        (agg & F.col("grouped"), "analytical_reporting"), (agg, "summary_reporting"), (F.size("tables") > 3, "complex_operational"), (F.col("sorted"), "listing_report")], "general_query")
