"""Row-wise rules over the query log and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import rules as R
from reportmill.plans.registry import query, table
from reportmill.sources.corpus import load, oracle

Q, C, P, I = (oracle(n) for n in ("report_query", "report_catalog", "report_param", "report_item"))


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def sql_cases(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: DuckDB's reading of one `key=value;...` entry.
def sql_entry(key: str) -> str:
    return f"nullif(trim(regexp_extract(c, '(?i)(?:^|;)\\s*{key}\\s*=([^;]*)', 1)), '')"


CONNECTIONS = f"(SELECT report_id, provider, CASE WHEN report_id % 3 = 0 THEN connect_string || ';Integrated Security=SSPI' WHEN report_id % 3 = 1 THEN 'server=S' || report_id || '; database=D' ELSE connect_string END AS c FROM {C})"


def connections(spark: SparkSession, d: str) -> DataFrame:
    """Connection strings in three spellings."""
    c = load(spark, d, "report_catalog")
    text = F.when(F.col("report_id") % 3 == 0, F.concat("connect_string", F.lit(";Integrated Security=SSPI"))).when(F.col("report_id") % 3 == 1, F.concat(F.lit("server=S"), "report_id", F.lit("; database=D"))).otherwise(F.col("connect_string"))
    return c.select("report_id", "provider", text.alias("c"))


@query(f"""SELECT report_id, coalesce({sql_entry('data source')}, {sql_entry('server')}) AS server, coalesce({sql_entry('initial catalog')}, {sql_entry('database')}) AS database,
coalesce(lower({sql_entry('integrated security')}) IN ('true', 'sspi', 'yes'), false) AS integrated FROM {CONNECTIONS}""")
def parse_connection(spark: SparkSession, d: str) -> DataFrame:
    return connections(spark, d).select("report_id", *(v.alias(k) for k, v in R.connection(F.col("c")).items()))


DB = "coalesce(nullif(regexp_extract(c, '(?i)Initial Catalog=([^;]+)', 1), ''), 'unknown_db')"


@query(f"SELECT report_id, {DB} AS database FROM {CONNECTIONS}")
def database_name(spark: SparkSession, d: str) -> DataFrame:
    return connections(spark, d).select("report_id", R.database_name(F.col("c")).alias("database"))


@query(f"SELECT report_id, 'Report_' || report_id || ':' || {DB} AS label FROM {CONNECTIONS}")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return connections(spark, d).select("report_id", F.concat_ws(":", F.concat(F.lit("Report_"), "report_id"), R.database_name(F.col("c"))).alias("label"))


@query(f"SELECT report_id, CASE provider WHEN 'SQL' THEN 'SQL Server' WHEN 'OLEDB' THEN 'OLE DB' WHEN 'ODBC' THEN 'ODBC' WHEN 'ORACLE' THEN 'Oracle' END AS kind FROM {C}")
def source_type(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_catalog").select("report_id", R.source_type(F.col("provider")).alias("kind"))


@query(f"SELECT report_id, CASE WHEN report_id % 3 = 0 THEN 'Windows' ELSE 'Database' END AS mode FROM {C}")
def auth_mode(spark: SparkSession, d: str) -> DataFrame:
    return connections(spark, d).select("report_id", R.auth_mode(R.connection(F.col("c"))["integrated"]).alias("mode"))


SHAPE = """CASE WHEN contains(upper(sql_text), 'SUM(') OR contains(upper(sql_text), 'COUNT(') OR contains(upper(sql_text), 'AVG(') THEN 'Aggregation' WHEN contains(upper(sql_text), 'JOIN') THEN 'Join Query'
WHEN contains(upper(sql_text), 'WHERE') AND (contains(upper(sql_text), 'BETWEEN') OR contains(sql_text, '>=') OR contains(sql_text, '<=') OR contains(sql_text, '>')) THEN 'Filtered Query' WHEN contains(upper(sql_text), 'ORDER BY') THEN 'Sorted Query' WHEN contains(upper(sql_text), 'GROUP BY') THEN 'Grouped Query' ELSE 'Basic Query' END"""


@query(f"SELECT query_id, {SHAPE} AS shape FROM {Q}")
def classify_query_shape(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_query").select("query_id", R.query_shape(F.col("sql_text")).alias("shape"))


STATEMENTS = "CASE query_id % 6 WHEN 0 THEN concat(' insert into x ', sql_text) WHEN 1 THEN 'EXEC p' WHEN 2 THEN concat('WITH a AS (', sql_text, ')') WHEN 3 THEN concat('{call p', '}') WHEN 4 THEN 'procedure' ELSE sql_text END"
#: The kind of a statement, of a text named q.
STATEMENT = """CASE WHEN starts_with(upper(trim(q)), 'SELECT') THEN 'SELECT' WHEN starts_with(upper(trim(q)), 'INSERT') THEN 'INSERT' WHEN starts_with(upper(trim(q)), 'UPDATE') THEN 'UPDATE' WHEN starts_with(upper(trim(q)), 'DELETE') THEN 'DELETE' WHEN starts_with(upper(trim(q)), 'CREATE') THEN 'CREATE'
WHEN starts_with(upper(trim(q)), 'ALTER') THEN 'ALTER' WHEN starts_with(upper(trim(q)), 'DROP') THEN 'DROP' WHEN contains(upper(q), 'EXEC') OR contains(upper(q), 'CALL') THEN 'PROCEDURE' ELSE 'UNKNOWN' END"""


@query(f"SELECT query_id, {STATEMENT} AS kind FROM (SELECT query_id, {STATEMENTS} AS q FROM {Q})")
def statement_type(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_query").select("query_id", R.statement_type(F.expr(STATEMENTS)).alias("kind"))


PURPOSE = """CASE WHEN regexp_matches(lower(param_name), 'date|from|to|start|end') THEN 'date_filter' WHEN regexp_matches(lower(param_name), 'region|location|office|branch') THEN 'location_filter' WHEN regexp_matches(lower(param_name), 'product|item|category') THEN 'product_filter'
WHEN regexp_matches(lower(param_name), 'customer|client|account') THEN 'customer_filter' WHEN regexp_matches(lower(param_name), 'employee|staff|user') THEN 'employee_filter' ELSE 'general_filter' END"""


@query(f"SELECT report_id, param_name, {PURPOSE} AS purpose FROM {P}")
def param_purpose(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_param").select("report_id", "param_name", R.param_purpose(F.col("param_name")).alias("purpose"))


@query(f"SELECT report_id, param_name AS field, CASE WHEN {PURPOSE} = 'date_filter' THEN 'date_range' ELSE 'categorical' END AS filter_type, true AS is_parameter, 'Parameter-driven filter: ' || param_name AS condition FROM {P}")
def param_to_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("param_name")
    return load(spark, d, "report_param").select("report_id", n.alias("field"), R.param_filter_type(n).alias("filter_type"), F.lit(True).alias("is_parameter"), F.concat(F.lit("Parameter-driven filter: "), n).alias("condition"))


CONDITIONS = """CASE query_id % 14 WHEN 0 THEN concat('Region = @', 'Region') WHEN 1 THEN concat('a.Price BETWEEN ', query_id, ' AND 9') WHEN 2 THEN 'MONTH(SaleDate) IN (1, 2)' WHEN 3 THEN 'YEAR(d) = 2020'
WHEN 4 THEN concat('d >= ', chr(39), '2020', chr(39)) WHEN 5 THEN 'kind IN (1, 2)' WHEN 6 THEN concat('n LIKE ', chr(39), 'a', chr(39)) WHEN 7 THEN concat('c.Amount > ', query_id) WHEN 8 THEN 'a.OrderDate >= @StartDate'
WHEN 9 THEN concat('d<=', chr(34), '2021', chr(34)) WHEN 10 THEN concat('s = ', chr(39), 'x', chr(39)) WHEN 11 THEN 'Width < 5' WHEN 12 THEN 'y = 7' ELSE 'EXISTS z' END"""
#: Kind, type, values and pattern of a condition, as the SQL has them.
_FILTERS = (
    ("'parameter_date'", "'date_range'", 1, r"'(?i)(\w+)\s*=\s*@(\w+)'"), ("'date_range'", "'date_range'", 2, r"'(?i)(\w+)\s*BETWEEN\s*(.+)\s*AND\s*(.+)'"), ("'month_filter'", "'date_range'", 1, r"'(?i)MONTH\((\w+)\)\s*IN\s*\(([^)]+)\)'"),
    ("'year_filter'", "'date_range'", 1, r"'(?i)YEAR\((\w+)\)\s*=\s*(\d+)'"), ("'date_gte'", "'date_range'", 1, r"""'(?i)(\w+)\s*>=\s*[''"]([^''"]+)[''"]'"""), ("'date_lte'", "'date_range'", 1, r"""'(?i)(\w+)\s*<=\s*[''"]([^''"]+)[''"]'"""),
    ("'in_list'", "'categorical'", 1, r"'(?i)(\w+)\s*IN\s*\(([^)]+)\)'"), ("'equals_string'", "'categorical'", 1, r"""'(?i)(\w+)\s*=\s*[''"]([^''"]+)[''"]'"""), ("'like_pattern'", "'categorical'", 1, r"""'(?i)(\w+)\s*LIKE\s*[''"]([^''"]+)[''"]'"""),
    ("'greater_than'", "'numeric_range'", 1, r"'(?i)(\w+)\s*>\s*(\d+(?:\.\d+)?)'"), ("'less_than'", "'numeric_range'", 1, r"'(?i)(\w+)\s*<\s*(\d+(?:\.\d+)?)'"), ("'equals_number'", "'numeric_range'", 1, r"'(?i)(\w+)\s*=\s*(\d+(?:\.\d+)?)'"),
    ("'parameter_range'", "'parameter_based'", 1, r"'(\w+)\s*[<>]=?\s*[@$:](\w+)'"),
)
KINDS = sql_cases([(f"regexp_matches(c, {p})", k) for k, _, _, p in _FILTERS], "'other'")
KTYPES = sql_cases([(f"regexp_matches(c, {p})", t) for _, t, _, p in _FILTERS], "'categorical'")
KFIELDS = sql_cases([(f"regexp_matches(c, {p})", f"lower(regexp_extract(c, {p}, 1))") for *_, p in _FILTERS], "'unknown'")
KVALUES = sql_cases([(f"regexp_matches(c, {p})", n) for _, _, n, p in _FILTERS], "0")
CTYPE = "CASE WHEN contains(lower(c), 'between') THEN 'range' WHEN contains(lower(c), ' in ') THEN 'in_list' WHEN contains(lower(c), 'like') THEN 'pattern_match' WHEN contains(c, '>=') THEN 'greater_equal' WHEN contains(c, '>') THEN 'greater_than' WHEN contains(c, '<=') THEN 'less_equal' WHEN contains(c, '<') THEN 'less_than' WHEN contains(c, '=') THEN 'equals' ELSE 'unknown' END"


def conditions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_query").select("query_id", F.expr(CONDITIONS).alias("c"))


@query(f"SELECT query_id, {KINDS} AS kind, {KTYPES} AS filter_type, {KFIELDS} AS field FROM (SELECT query_id, {CONDITIONS} AS c FROM {Q})")
def classify_filter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return conditions(spark, d).select("query_id", R.filter_kind(c).alias("kind"), R.filter_type(c).alias("filter_type"), R.filter_field(c).alias("field"))


@query(f"SELECT query_id, {CTYPE} AS condition_type FROM (SELECT query_id, {CONDITIONS} AS c FROM {Q})")
def filter_condition_type(spark: SparkSession, d: str) -> DataFrame:
    return conditions(spark, d).select("query_id", R.condition_type(F.col("c")).alias("condition_type"))


@query(f"SELECT query_id, {KFIELDS} AS field, {KTYPES} AS filter_type, {CTYPE} AS condition_type, contains(c, '@') AS is_parameter, {KVALUES} AS n_values FROM (SELECT query_id, {CONDITIONS} AS c FROM {Q})")
def normalize_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return conditions(spark, d).select("query_id", R.filter_field(c).alias("field"), R.filter_type(c).alias("filter_type"), R.condition_type(c).alias("condition_type"), c.contains("@").alias("is_parameter"), R.filter_values(c).alias("n_values"))


CALC = r"coalesce(regexp_matches(expression, '(?i)=Sum\(|=Count\(|=Avg\(|=Max\(|=Min\(|=.*\+.*|=.*\-.*|=.*\*.*|=.*/.*'), false)"
#: Type, level and pattern of a calculation, as the SQL has them.
_CALCULATIONS = (
    ("'aggregation'", "'SUM'", r"'(?i)Sum\s*\(\s*Fields!(\w+)\.Value\s*\)'"), ("'aggregation'", "'COUNT'", r"'(?i)Count\s*\(\s*Fields!(\w+)\.Value\s*\)'"), ("'aggregation'", "'AVG'", r"'(?i)Avg\s*\(\s*Fields!(\w+)\.Value\s*\)'"), ("'aggregation'", "'MAX'", r"'(?i)Max\s*\(\s*Fields!(\w+)\.Value\s*\)'"),
    ("'aggregation'", "'MIN'", r"'(?i)Min\s*\(\s*Fields!(\w+)\.Value\s*\)'"), ("'formula'", "'ARITHMETIC'", r"'(?i)Fields!(\w+)\.Value\s*[-+*/]\s*Fields!(\w+)\.Value'"), ("'formula'", "'ARITHMETIC'", r"'(?i)Fields!(\w+)\.Value\s*[-+*/]\s*[\d.]+'"), ("'conditional'", "'CONDITIONAL'", r"'(?i)IIF\s*\('"),
    ("'date_function'", "'FORMAT'", r"""'(?i)Format\s*\(\s*Fields!(\w+)\.Value\s*,\s*["'']([^"'']+)["'']\s*\)'"""), ("'date_function'", "'YEAR'", r"'(?i)Year\s*\(\s*Fields!(\w+)\.Value\s*\)'"), ("'date_function'", "'MONTH'", r"'(?i)Month\s*\(\s*Fields!(\w+)\.Value\s*\)'"),
)
_BEHIND = "(CASE WHEN starts_with(expression, '=') THEN substr(expression, 2) END)"
CALC_TYPE = sql_cases([(f"regexp_matches({_BEHIND}, {p})", k) for k, _, p in _CALCULATIONS], "NULL")
CALC_LEVEL = sql_cases([(f"regexp_matches({_BEHIND}, {p})", v) for _, v, p in _CALCULATIONS], "NULL")


@query(f"SELECT item_name, {CALC} AS is_calc FROM {I}")
def is_calculation(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_item").select("item_name", R.is_calculation(F.col("expression")).alias("is_calc"))


@query(rf"SELECT item_name, {CALC_TYPE} AS kind, {CALC_LEVEL} AS level, array_to_string(regexp_extract_all(expression, 'Fields!(\w+)\.Value', 1), ',') AS fields FROM {I} WHERE {CALC} AND {CALC_TYPE} IS NOT NULL")
def classify_calculation(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expression")
    t = load(spark, d, "report_item").where(R.is_calculation(e)).select("item_name", R.calculation_type(e).alias("kind"), R.calculation_level(e).alias("level"), F.concat_ws(",", R.calculation_fields(e)).alias("fields"))
    return t.where("kind IS NOT NULL")


#: What a report shows, by SQL: layout, fields, groups, aggregations, filters and date filters.
OUTPUT = rf"""(SELECT c.report_id, CASE WHEN coalesce(i.charts, 0) > 0 THEN 'chart_report' WHEN coalesce(i.tables, 0) > 0 AND coalesce(g.across, 0) > 0 THEN 'matrix_report' WHEN coalesce(i.tables, 0) > 0 THEN 'tabular_report' ELSE 'custom_report' END AS layout,
coalesce(i.fields, CAST([] AS VARCHAR[])) AS fields, coalesce(g.fields, CAST([] AS VARCHAR[])) AS groups, coalesce(i.sums, 0) AS sums, coalesce(i.calculations, CAST([] AS VARCHAR[])) AS calculations
FROM {C} c LEFT JOIN (SELECT report_id, count(*) FILTER (item_type = 'Chart') AS charts, count(*) FILTER (item_type = 'Table') AS tables, list_distinct(flatten(list(list_transform(regexp_extract_all(expression, 'Fields!(\w+)\.Value', 1), lambda x: lower(x))) FILTER (item_type <> 'Chart'))) AS fields,
  count(*) FILTER (item_type <> 'Chart' AND {CALC} AND {CALC_TYPE} = 'aggregation') AS sums, list_distinct(list({CALC_TYPE} || ':' || {CALC_LEVEL}) FILTER (item_type <> 'Chart' AND {CALC} AND {CALC_TYPE} IS NOT NULL)) AS calculations FROM {I} GROUP BY 1) i USING (report_id)
LEFT JOIN (SELECT report_id, count(*) FILTER (kind = 'column') AS across, list_distinct(flatten(list(list_transform(regexp_extract_all(expression, 'Fields!(\w+)\.Value', 1), lambda x: lower(x))))) AS fields FROM {oracle('report_group')} GROUP BY 1) g USING (report_id))"""


def outputs(spark: SparkSession, d: str) -> DataFrame:
    from reportmill.operators.reports import outputs as made

    return made(load(spark, d, "report_catalog"), load(spark, d, "report_item"), load(spark, d, "report_group"))


@query(f"SELECT report_id, layout FROM {OUTPUT}")
def report_layout_type(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d).select("report_id", "layout")


#: Filters of reports by SQL: those of their parameters, and those in the WHERE parts of their queries.
FILTERS = rf"""(SELECT report_id, lower(param_name) || ':unknown' AS filter, CASE WHEN {PURPOSE} = 'date_filter' THEN 1 ELSE 0 END AS dated FROM {P} UNION ALL
SELECT report_id, {KFIELDS} || ':' || {CTYPE}, CASE WHEN {KTYPES} = 'date_range' THEN 1 ELSE 0 END FROM (SELECT report_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(
  regexp_extract(regexp_replace(trim(regexp_replace(regexp_replace(sql_text, '--[^\n]*', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' '), '[`"\[\]]', '', 'g'), '(?i)\bWHERE\s+(.*?)(?:\s+GROUP\s+BY\b|\s+ORDER\s+BY\b|\s+LIMIT\b|\s+HAVING\b|$)', 1),
  '(?i)(\bBETWEEN\s+\S+)\s+AND\s', '\1 ~AND~ ', 'g'), '(?i)\s+AND\s+'), lambda x: replace(x, '~AND~', 'AND')), lambda x: x <> '')) AS c FROM {Q}) WHERE {KINDS} <> 'other')"""


@query(f"""SELECT o.report_id, CASE WHEN coalesce(f.dates, 0) > 0 AND sums > 0 AND len(groups) > 0 THEN 'periodic_summary_report' WHEN coalesce(f.dates, 0) > 0 AND len(fields) > 10 THEN 'detailed_transactional_report' WHEN sums > 0 AND len(groups) > 0 THEN 'analytical_summary_report'
WHEN len(fields) > 10 AND coalesce(f.n, 0) = 0 THEN 'master_data_report' ELSE 'custom_operational_report' END AS purpose FROM {OUTPUT} o LEFT JOIN (SELECT report_id, sum(dated) AS dates, count(*) AS n FROM {FILTERS} GROUP BY 1) f ON f.report_id = o.report_id""")
def business_purpose(spark: SparkSession, d: str) -> DataFrame:
    from reportmill.plans.reportpairs import contexts

    return contexts(spark, d).select("report_id", "purpose")


def sql_best(text: str, names: str, lists: str) -> str:
    """The name of the list of whose words the text holds most, the first on a tie."""
    hits = f"list_transform({lists}, lambda k: len(list_filter(k, lambda w: contains(lower({text}), w))))"
    return f"CASE WHEN list_max({hits}) = 0 THEN 'unknown' ELSE {names}[list_position({hits}, list_max({hits}))] END"


def sql_field_domain(text: str) -> str:
    return sql_best(text, "['sales', 'customer', 'financial', 'inventory', 'hr', 'analytics', 'operations', 'marketing']", """[['sale', 'revenue', 'price', 'quantity', 'product', 'order', 'invoice', 'sales', 'sold', 'selling', 'purchase'],
['customer', 'client', 'contact', 'email', 'phone', 'address', 'name', 'customers'], ['amount', 'cost', 'profit', 'expense', 'budget', 'payment', 'financial', 'money', 'dollar', 'currency'], ['stock', 'warehouse', 'item', 'category', 'supplier', 'inventory', 'reorder', 'stocking', 'supply'],
['employee', 'staff', 'department', 'salary', 'hire', 'position', 'human', 'resource', 'payroll'], ['count', 'sum', 'average', 'total', 'percentage', 'ratio', 'analysis', 'metric', 'kpi'], ['process', 'operation', 'workflow', 'task', 'activity', 'production', 'manufacturing'],
['campaign', 'lead', 'prospect', 'marketing', 'promotion', 'advertisement', 'channel']]""")


def sql_table_set_domain(text: str) -> str:
    return sql_best(text, "['sales', 'inventory', 'hr', 'financial', 'operations']", """[['sales', 'order', 'invoice', 'product', 'customer'], ['inventory', 'stock', 'warehouse', 'item', 'supplier'], ['employee', 'staff', 'department', 'payroll', 'hire'],
['finance', 'accounting', 'budget', 'expense', 'payment'], ['production', 'manufacturing', 'operation', 'process']]""")


@query(f"SELECT item_name, {sql_field_domain('expression')} AS domain FROM {I}")
def field_domain(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "report_item").select("item_name", R.field_domain(F.col("expression")).alias("domain"))


def sql_table_domain(t: str) -> str:
    schema, rest = f"(CASE WHEN contains({t}, '.') THEN split_part(lower({t}), '.', 1) END)", f"(CASE WHEN contains({t}, '.') THEN regexp_replace(lower({t}), '^[^.]*\\.', '') ELSE lower({t}) END)"
    return f"""CASE WHEN {schema} IN ('sales', 'order', 'transaction') THEN 'sales' WHEN {schema} IN ('customer', 'person', 'contact') THEN 'customer' WHEN {schema} IN ('product', 'inventory', 'catalog') THEN 'product' WHEN {schema} IN ('hr', 'employee', 'payroll') THEN 'hr' WHEN {schema} IN ('finance', 'accounting', 'billing') THEN 'finance'
WHEN regexp_matches({rest}, 'sale|order|transaction|revenue|invoice') THEN 'sales' WHEN regexp_matches({rest}, 'customer|client|person|contact|account') THEN 'customer' WHEN regexp_matches({rest}, 'product|item|inventory|catalog|sku') THEN 'product'
WHEN regexp_matches({rest}, 'employee|staff|payroll|department') THEN 'hr' WHEN regexp_matches({rest}, 'payment|billing|ledger|budget') THEN 'finance' ELSE 'general' END"""


VOCABULARY = r"(SELECT DISTINCT unnest(regexp_extract_all(sql_text, '(?:FROM|JOIN) ([A-Za-z]+[.A-Za-z]*)', 1)) AS t FROM " + Q + ")"


@query(f"SELECT t, {sql_table_domain('t')} AS domain FROM {VOCABULARY}")
def table_domain(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "report_query").select(F.explode(F.regexp_extract_all("sql_text", F.lit(r"(?:FROM|JOIN) ([A-Za-z]+[.A-Za-z]*)"), 1)).alias("t")).distinct()
    return t.select("t", R.table_domain(F.col("t")).alias("domain"))


@query(f"SELECT query_id, {sql_table_set_domain('x')} AS domain FROM (SELECT query_id, array_to_string(regexp_extract_all(upper(sql_text), '(?:FROM|JOIN)\\s+([A-Z_][A-Z0-9_]*(?:\\.[A-Z_][A-Z0-9_]*)?)', 1), ' ') AS x FROM {Q})".replace("\\\\", "\\"))
def table_set_domain(spark: SparkSession, d: str) -> DataFrame:
    names = F.regexp_extract_all(F.upper("sql_text"), F.lit(r"(?:FROM|JOIN)\s+([A-Z_][A-Z0-9_]*(?:\.[A-Z_][A-Z0-9_]*)?)"), 1)
    return load(spark, d, "report_query").select("query_id", R.table_set_domain(F.concat_ws(" ", names)).alias("domain"))


SCORES = "(SELECT query_id, query_id % 101 AS score FROM " + Q + ")"
# Cut-off sets by use.
BANDS = {"batch": ([(80, "high"), (50, "medium")], "low", True), "label": ([(85, "high"), (50, "medium")], "low", False), "ui": ([(70, "high"), (40, "medium")], "low", True), "matrix": ([(80, "high"), (40, "medium")], "low", True), "colour": ([(80, "green"), (60, "yellow"), (40, "orange")], "red", True)}


@query(f"""SELECT query_id, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS batch, CASE WHEN score > 85 THEN 'high' WHEN score > 50 THEN 'medium' ELSE 'low' END AS label, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS ui,
CASE WHEN score >= 80 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS matrix, CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS colour FROM {SCORES}""")
def similarity_band(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "report_query").select("query_id", (F.col("query_id") % 101).alias("score"))
    return s.select("query_id", *(R.band(F.col("score"), *b).alias(k) for k, b in BANDS.items()))


@query(f"SELECT report_id, report_name || '.rdl' AS name, report_id || '_' || report_name || '.rdl' AS bare, report_id || '.rdl' AS unprefixed FROM {C}")
def clean_file_name(spark: SparkSession, d: str) -> DataFrame:
    """The two rules for names: without a batch's `file_N_`, and what follows the first `_`."""
    c = load(spark, d, "report_catalog").select("report_id", F.concat(F.lit("file_"), "report_id", F.lit("_"), "report_name", F.lit(".rdl")).alias("f"))
    name = R.clean_file_name(F.col("f"))
    return c.select("report_id", name.alias("name"), R.bare_file_name(F.col("f")).alias("bare"), R.bare_file_name(name).alias("unprefixed"))


@query("SELECT count(*) FILTER (regexp_matches(lower(url), '/[0-9]+$')) AS valid, count(*) FILTER (NOT regexp_matches(lower(url), '/[0-9]+$')) AS invalid, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def upload_admission(spark: SparkSession, d: str) -> DataFrame:
    ok = F.lower("url").rlike("/[0-9]+$")
    return table(spark, d, "pages").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def page_field_extract(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"), F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '))) AS text_hash FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))).alias("text_hash"))


@query(r"SELECT lang AS provider, count(*) AS texts, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS BIGINT) AS tokens, round(sum(len(regexp_extract_all(text, '[^ \t\n\r]+'))) * 0.0004 / 1000, 8) AS cost FROM documents GROUP BY ROLLUP (lang)")
def embedding_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("lang", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("n"))
    return words.rollup("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens"), F.round(F.sum("n") * 0.0004 / 1000, 8).alias("cost")).withColumnRenamed("lang", "provider")
