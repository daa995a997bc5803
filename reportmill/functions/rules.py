"""Classification rules on names, expressions and query texts, as Column functions.

Every rule is an ordered list of cases; the first that holds wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules that decide results. Names are matched as substrings of lower-case text, in this order.
PURPOSES = {
    "date_filter": ("date", "from", "to", "start", "end"), "location_filter": ("region", "location", "office", "branch"), "product_filter": ("product", "item", "category"),
    "customer_filter": ("customer", "client", "account"), "employee_filter": ("employee", "staff", "user"),
}
SCHEMAS = {
    "sales": ("sales", "order", "transaction"), "customer": ("customer", "person", "contact"), "product": ("product", "inventory", "catalog"), "hr": ("hr", "employee", "payroll"), "finance": ("finance", "accounting", "billing"),
}
NAMES = {
    "sales": ("sale", "order", "transaction", "revenue", "invoice"), "customer": ("customer", "client", "person", "contact", "account"), "product": ("product", "item", "inventory", "catalog", "sku"),
    "hr": ("employee", "staff", "payroll", "department"), "finance": ("payment", "billing", "ledger", "budget"),
}
RELATED = (("sales", "customer"), ("sales", "product"), ("sales", "finance"), ("customer", "finance"), ("product", "inventory"), ("general", "sales"), ("general", "customer"), ("general", "product"), ("general", "finance"))
FIELD_DOMAINS = {
    "sales": ("sale", "revenue", "price", "quantity", "product", "order", "invoice", "sales", "sold", "selling", "purchase"),
    "customer": ("customer", "client", "contact", "email", "phone", "address", "name", "customers"),
    "financial": ("amount", "cost", "profit", "expense", "budget", "payment", "financial", "money", "dollar", "currency"),
    "inventory": ("stock", "warehouse", "item", "category", "supplier", "inventory", "reorder", "stocking", "supply"),
    "hr": ("employee", "staff", "department", "salary", "hire", "position", "human", "resource", "payroll"),
    "analytics": ("count", "sum", "average", "total", "percentage", "ratio", "analysis", "metric", "kpi"),
    "operations": ("process", "operation", "workflow", "task", "activity", "production", "manufacturing"),
    "marketing": ("campaign", "lead", "prospect", "marketing", "promotion", "advertisement", "channel"),
}
TABLE_SETS = {
    "sales": ("sales", "order", "invoice", "product", "customer"), "inventory": ("inventory", "stock", "warehouse", "item", "supplier"), "hr": ("employee", "staff", "department", "payroll", "hire"),
    "financial": ("finance", "accounting", "budget", "expense", "payment"), "operations": ("production", "manufacturing", "operation", "process"),
}
#: Condition patterns: kind, type, values that a match holds beside the field, and pattern. The last one is ours: comparisons
#: with a parameter, which the twelve before leave out.
FILTERS = (
    ("parameter_date", "date_range", 1, r"(?i)(\w+)\s*=\s*@(\w+)"), ("date_range", "date_range", 2, r"(?i)(\w+)\s*BETWEEN\s*(.+)\s*AND\s*(.+)"), ("month_filter", "date_range", 1, r"(?i)MONTH\((\w+)\)\s*IN\s*\(([^)]+)\)"),
    ("year_filter", "date_range", 1, r"(?i)YEAR\((\w+)\)\s*=\s*(\d+)"), ("date_gte", "date_range", 1, r"""(?i)(\w+)\s*>=\s*['"]([^'"]+)['"]"""), ("date_lte", "date_range", 1, r"""(?i)(\w+)\s*<=\s*['"]([^'"]+)['"]"""),
    ("in_list", "categorical", 1, r"(?i)(\w+)\s*IN\s*\(([^)]+)\)"), ("equals_string", "categorical", 1, r"""(?i)(\w+)\s*=\s*['"]([^'"]+)['"]"""), ("like_pattern", "categorical", 1, r"""(?i)(\w+)\s*LIKE\s*['"]([^'"]+)['"]"""),
    ("greater_than", "numeric_range", 1, r"(?i)(\w+)\s*>\s*(\d+(?:\.\d+)?)"), ("less_than", "numeric_range", 1, r"(?i)(\w+)\s*<\s*(\d+(?:\.\d+)?)"), ("equals_number", "numeric_range", 1, r"(?i)(\w+)\s*=\s*(\d+(?:\.\d+)?)"),
    ("parameter_range", "parameter_based", 1, r"(\w+)\s*[<>]=?\s*[@$:](\w+)"),
)
#: What makes an expression a calculation, and then its type, level and pattern, looked for behind the equals sign.
CALCULATED = r"(?i)=Sum\(|=Count\(|=Avg\(|=Max\(|=Min\(|=.*\+.*|=.*\-.*|=.*\*.*|=.*/.*"
CALCULATIONS = (
    ("aggregation", "SUM", r"(?i)Sum\s*\(\s*Fields!(\w+)\.Value\s*\)"), ("aggregation", "COUNT", r"(?i)Count\s*\(\s*Fields!(\w+)\.Value\s*\)"), ("aggregation", "AVG", r"(?i)Avg\s*\(\s*Fields!(\w+)\.Value\s*\)"),
    ("aggregation", "MAX", r"(?i)Max\s*\(\s*Fields!(\w+)\.Value\s*\)"), ("aggregation", "MIN", r"(?i)Min\s*\(\s*Fields!(\w+)\.Value\s*\)"),
    ("formula", "ARITHMETIC", r"(?i)Fields!(\w+)\.Value\s*[\+\-\*\/]\s*Fields!(\w+)\.Value"), ("formula", "ARITHMETIC", r"(?i)Fields!(\w+)\.Value\s*[\+\-\*\/]\s*[\d\.]+"), ("conditional", "CONDITIONAL", r"(?i)IIF\s*\("),
    ("date_function", "FORMAT", r"""(?i)Format\s*\(\s*Fields!(\w+)\.Value\s*,\s*["']([^"']+)["']\s*\)"""), ("date_function", "YEAR", r"(?i)Year\s*\(\s*Fields!(\w+)\.Value\s*\)"), ("date_function", "MONTH", r"(?i)Month\s*\(\s*Fields!(\w+)\.Value\s*\)"),
)


def cases(pairs: Sequence[tuple[Column, str]], other: str | Column) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(other)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def connection(c: Column) -> dict[str, Column]:
    """Server, database and whether the login is integrated, from `key=value;...`; keys have synonyms and any case."""
    m = F.transform_keys(F.str_to_map(c, F.lit(";"), F.lit("=")), lambda k, _: F.lower(F.trim(k)))
    first = lambda *keys: F.trim(F.coalesce(*(F.element_at(m, F.lit(k)) for k in keys)))
    return {"server": first("data source", "server", "address"), "database": first("initial catalog", "database"), "integrated": F.coalesce(F.lower(first("integrated security", "trusted_connection")).isin("true", "sspi", "yes"), F.lit(False))}


def database_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)Initial Catalog=([^;]+)", 1), F.lit("")), F.lit("unknown_db"))


def source_type(provider: Column) -> Column:
    p = F.upper(provider)
    return cases([(p.contains("SQL"), "SQL Server"), (p.contains("OLEDB"), "OLE DB"), (p.contains("ODBC"), "ODBC"), (p.contains("ORACLE"), "Oracle")], provider)


def auth_mode(integrated: Column) -> Column:
    return F.when(integrated, "Windows").otherwise("Database")


def query_shape(sql: Column) -> Column:
    u = F.upper(sql)
    ranged = contains_any(u, ("BETWEEN", ">=", "<=", ">"))
    return cases([(contains_any(u, ("SUM(", "COUNT(", "AVG(")), "Aggregation"), (u.contains("JOIN"), "Join Query"), (u.contains("WHERE") & ranged, "Filtered Query"), (u.contains("ORDER BY"), "Sorted Query"), (u.contains("GROUP BY"), "Grouped Query")], "Basic Query")


def statement_type(sql: Column) -> Column:
    u = F.upper(F.trim(sql))
    return cases([(u.startswith(k), k) for k in ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")] + [(contains_any(u, ("EXEC", "CALL")), "PROCEDURE")], "UNKNOWN")


def param_purpose(name: Column) -> Column:
    return cases([(contains_any(F.lower(name), words), purpose) for purpose, words in PURPOSES.items()], "general_filter")


def param_filter_type(name: Column) -> Column:
    """The type of the filter that a parameter of that name is."""
    return F.when(param_purpose(name) == "date_filter", "date_range").otherwise("categorical")


def filter_kind(condition: Column) -> Column:
    return cases([(condition.rlike(p), kind) for kind, *_, p in FILTERS], "other")


def filter_type(condition: Column) -> Column:
    return cases([(condition.rlike(p), t) for _, t, _, p in FILTERS], "categorical")


def filter_field(condition: Column) -> Column:
    return cases([(condition.rlike(p), F.lower(F.regexp_extract(condition, p, 1))) for *_, p in FILTERS], "unknown")


def filter_values(condition: Column) -> Column:
    """How many values a condition compares its field with."""
    out = F.lit(0)
    for *_, n, p in reversed(FILTERS):
        out = F.when(condition.rlike(p), n).otherwise(out)
    return out


def condition_type(condition: Column) -> Column:
    u = F.lower(condition)
    return cases([(u.contains("between"), "range"), (u.contains(" in "), "in_list"), (u.contains("like"), "pattern_match"), (u.contains(">="), "greater_equal"), (u.contains(">"), "greater_than"), (u.contains("<="), "less_equal"), (u.contains("<"), "less_than"), (u.contains("="), "equals")], "unknown")


def is_calculation(expression: Column) -> Column:
    return F.coalesce(expression.rlike(CALCULATED), F.lit(False))


def _behind_equals(expression: Column) -> Column:
    return F.when(expression.startswith("="), F.regexp_replace(expression, "^=", ""))


def calculation_type(expression: Column) -> Column:
    """aggregation, formula, conditional or date_function; null where no pattern is found."""
    e = _behind_equals(expression)
    return cases([(e.rlike(p), kind) for kind, _, p in CALCULATIONS], F.lit(None).cast("string"))


def calculation_level(expression: Column) -> Column:
    e = _behind_equals(expression)
    return cases([(e.rlike(p), level) for _, level, p in CALCULATIONS], F.lit(None).cast("string"))


def calculation_fields(expression: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(expression, F.lit(r"Fields!(\w+)\.Value"), 1))


def layout(charts: Column, column_groups: Column, tables: Column) -> Column:
    """A chart, else a matrix (a table with a column group), else a table, else anything."""
    return cases([(charts > 0, "chart_report"), ((tables > 0) & (column_groups > 0), "matrix_report"), (tables > 0, "tabular_report")], "custom_report")


def purpose(dates: Column, filters: Column, aggregations: Column, groups: Column, fields: Column) -> Column:
    """From the numbers of date filters, filters, aggregations, grouping fields and output fields."""
    detailed, summed = fields > 10, (aggregations > 0) & (groups > 0)
    return cases([((dates > 0) & summed, "periodic_summary_report"), ((dates > 0) & detailed, "detailed_transactional_report"), (summed, "analytical_summary_report"), (detailed & (filters == 0), "master_data_report")], "custom_operational_report")


def keyword_domain(text: Column, domains: dict[str, Sequence[str]]) -> Column:
    """The domain of whose keywords the text holds most; the first on a tie, unknown without any."""
    low = F.lower(text)
    hits = [sum((low.contains(w).cast("int") for w in words), F.lit(0)) for words in domains.values()]
    best = F.greatest(*hits)
    return cases([(best == 0, "unknown"), *((h == best, k) for h, k in zip(hits, domains))], "unknown")


def field_domain(fields: Column) -> Column:
    return keyword_domain(fields, FIELD_DOMAINS)


def table_set_domain(tables: Column) -> Column:
    return keyword_domain(tables, TABLE_SETS)


def table_domain(name: Column) -> Column:
    """By schema if the name has a known one, else by what the part behind the schema contains."""
    low = F.lower(name)
    dotted = low.contains(".")
    schema, rest = F.when(dotted, F.split_part(low, F.lit("."), F.lit(1))), F.when(dotted, F.regexp_replace(low, r"^[^.]*\.", "")).otherwise(low)
    return cases([(schema.isin(*v), k) for k, v in SCHEMAS.items()] + [(contains_any(rest, v), k) for k, v in NAMES.items()], "general")


def band(score: Column, cuts: Sequence[tuple[float, str]], other: str, inclusive: bool = True) -> Column:
    """A label by falling cut-offs."""
    return cases([((score >= c) if inclusive else (score > c), name) for c, name in cuts], other)


def clean_file_name(name: Column) -> Column:
    """Without the `file_N_` of a batch."""
    return F.regexp_replace(name, r"^file_\d+_", "")


def bare_file_name(name: Column) -> Column:
    """What follows the first `_`; the whole name without one."""
    return F.regexp_replace(name, r"(?s)^[^_]*_", "")
