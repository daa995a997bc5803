"""Derived corpora: a query log and a report catalogue, from the parts table.

Each is one SQL text that Spark and DuckDB both run, so an oracle can rebuild it. Quotes are chr(39), since the engines
escape them differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The vocabulary of table names.
TABLES = ("Sales.Orders", "Sales.Customer", "HR.Employee", "Product.Item", "Finance.Payment", "Inventory.Stock", "dbo.Ledger", "SalesReport", "Person.Contact", "Audit.Log")
PARAMS = ("StartDate", "EndDate", "Region", "ProductCategory", "ClientId", "UserName", "Status", "MinAmount")
EXPRESSIONS = (
    "=Sum(Fields!Amount.Value)", "=Fields!Qty.Value * Fields!Price.Value", "=Fields!CustomerName.Value", "=Year(Fields!OrderDate.Value) + 1", "=IIF(Fields!Stock.Value > 0, 1 + 2, 0)", "Header", "=Avg(Fields!Salary.Value)",
    "=Year(Fields!OrderDate.Value)",
)
MANY_FIELDS = "=" + " & ".join(f"Fields!F{i}.Value" for i in range(1, 13))
GROUPS = ("=Fields!Region.Value", "=Fields!Year.Value", "=Fields!CustomerName.Value", "=Fields!A.Value")
PROVIDERS = ("SQL", "OLEDB", "ODBC", "ORACLE")
YEARS = ("2008", "2010", "2016")


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _t(k: int) -> str:
    return _case(f"(p_size + {k}) % 10", TABLES)


_TEXTS = (
    f"concat('SELECT TOP 10 a.', p_type, 'ID, ISNULL(a.Amount, 0) FROM ', {_t(0)}, ' a WHERE a.OrderDate >= @StartDate AND a.DueDate <= @StartDate2')",
    f"concat('SELECT CustomerID, SUM(Amount) AS Total FROM ', {_t(1)}, ' WHERE Status = ', chr(39), p_type, chr(39), ' GROUP BY CustomerID')",
    f"concat('SELECT b.ID, COUNT(*) FROM ', {_t(0)}, ' b INNER JOIN ', {_t(3)}, ' c ON b.ID = c.ID WHERE c.Amount > ', CAST(p_size AS {{text}}), ' GROUP BY b.ID ORDER BY b.ID')",
    f"concat('SELECT id::text, EXTRACT(year FROM created_at) FROM ', {_t(2)}, ' WHERE status = $1')",
    f"concat('SELECT `name`, IFNULL(`price`, 0) FROM ', {_t(4)}, ' LIMIT ', CAST(p_size AS {{text}}))",
    f"concat('SELECT NVL(x, 0) FROM ', {_t(5)}, ' WHERE ROWNUM < ', CAST(p_size AS {{text}}), ' -- ', p_name)",
)
_ID = "CAST(floor(p_partkey / 4) AS BIGINT)"

SQL = {
    "report_query": f"SELECT p_partkey AS query_id, {_ID} AS report_id, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END AS sql_text FROM {part}",
    "report_catalog": (
        f"SELECT report_id, concat('Report_', CAST(report_id AS {{text}})) AS report_name, {_case('report_id % 3', YEARS)} AS schema_year, {_case('report_id % 4', PROVIDERS)} AS provider, "
        f"concat('Data Source=SRV', CAST(report_id % 5 AS {{text}}), ';Initial Catalog=DB', CAST(report_id % 7 AS {{text}})) AS connect_string FROM (SELECT DISTINCT {_ID} AS report_id FROM {{part}}) r"
    ),
    "report_param": f"SELECT {_ID} AS report_id, {_case('p_size % 8', PARAMS)} AS param_name, CASE WHEN p_size % 8 < 2 THEN 'DateTime' WHEN p_size % 8 = 7 THEN 'Integer' ELSE 'String' END AS data_type FROM {{part}} WHERE p_partkey % 3 = 0",
    "report_dataset": f"SELECT {_ID} AS report_id, concat('Set', CAST(p_size % 25 AS {{text}}), '_', CAST(p_partkey % 7 AS {{text}})) AS dataset_name, CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END AS sql_text, CASE WHEN floor(p_partkey / 4) % 3 = 0 THEN 'Shared' ELSE concat('SRV', CAST(floor(p_partkey / 4) % 5 AS {text}), '.', CAST(floor(p_partkey / 4) % 97 AS {text})) END AS source_name, concat('txt', CAST(p_partkey % 150 AS {text})) AS item_name FROM {part}",
    "dataset_field": "SELECT p_partkey AS query_id, field_name, CASE WHEN field_name <> 'A' THEN concat('=Fields!A.Value * ', CAST(p_size AS {text})) END AS expression FROM (SELECT p_partkey, p_size, 'A' AS field_name FROM {part} UNION ALL SELECT p_partkey, p_size, 'B' FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, p_size, 'C' FROM {part} WHERE p_partkey % 15 = 0) f",
    "report_item": f"SELECT {_ID} AS report_id, concat('txt', CAST(p_partkey AS {{text}})) AS item_name, CASE p_size % 5 WHEN 0 THEN 'Table' WHEN 1 THEN 'Chart' ELSE 'TextBox' END AS item_type, CASE WHEN p_partkey % 29 = 0 THEN '{MANY_FIELDS}' ELSE {_case('p_size % 8', EXPRESSIONS)} END AS expression FROM {{part}}",
    "report_source": f"SELECT report_id, 'Main' AS source_name, concat('Data Source=SRV', CAST(report_id % 5 AS {{text}}), ';Initial Catalog=DB', CAST(report_id % 7 AS {{text}})) AS connect_string FROM (SELECT DISTINCT {_ID} AS report_id FROM {{part}}) r UNION ALL SELECT DISTINCT {_ID}, 'Archive', concat('Server=A;Initial Catalog=Old', CAST({_ID} % 5 AS {{text}})) FROM {{part}} WHERE {_ID} % 3 = 0",
    "report_group": f"SELECT {_ID} AS report_id, concat('txt', CAST(p_partkey AS {{text}})) AS item_name, 'row' AS kind, {_case('p_partkey % 4', GROUPS)} AS expression FROM {{part}} WHERE p_size % 5 = 0 UNION ALL SELECT {_ID}, concat('txt', CAST(p_partkey AS {{text}})), 'column', '=Fields!Month.Value' FROM {{part}} WHERE p_size % 5 = 0 AND p_partkey % 3 = 0 UNION ALL SELECT {_ID}, concat('txt', CAST(p_partkey AS {{text}})), 'category', '=Fields!A.Value' FROM {{part}} WHERE p_size % 5 = 1",
}


def oracle(name: str) -> str:
    """The corpus as a subquery for DuckDB."""
    return "(" + SQL[name].replace("{part}", "part").replace("{text}", "VARCHAR") + ")"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The corpus. Parts are dealt by key first: a million of them are a file so small that one task would read, and work on, all."""
    return spark.sql(SQL[name].replace("{text}", "STRING"), part=spark.read.parquet(f"{sf_dir}/part.parquet").repartition("p_partkey"))
