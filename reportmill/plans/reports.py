"""Report measures, validation and canned reports over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators import measures, validation
from reportmill.plans.registry import query, table
from reportmill.plans.rules import Q
from reportmill.sources import reportxml

SOUND = "report_id % 50 <> 49"


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL")
def measure_basic(spark: SparkSession, d: str) -> DataFrame:
    return measures.basic(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("""WITH t AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, round(total, 4) AS total, round(total * 100 / sum(total) OVER (), 6) AS share, CAST(dense_rank() OVER (ORDER BY total DESC) AS INT) AS place FROM t""")
def measure_share_rank(spark: SparkSession, d: str) -> DataFrame:
    return measures.share_rank(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")


@query("""WITH t AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT year, month, round(total, 2) AS total, round(sum(total) OVER (PARTITION BY year ORDER BY month), 2) AS year_to_date FROM t""")
def measure_ytd_mtd(spark: SparkSession, d: str) -> DataFrame:
    return measures.to_date_totals(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, round(total, 2) AS total, round(sum(total) OVER (PARTITION BY date_trunc('month', day) ORDER BY day), 2) AS month_to_date FROM t""")
def measure_mtd_daily(spark: SparkSession, d: str) -> DataFrame:
    return measures.month_to_date(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("""WITH t AS (SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
p AS (SELECT *, lag(total) OVER (ORDER BY year, month) AS b FROM t)
SELECT year, month, round(total, 2) AS total, round(b, 2) AS previous, round((total - b) / nullif(b, 0), 8) AS growth FROM p""")
def measure_prev_period(spark: SparkSession, d: str) -> DataFrame:
    return measures.previous_period(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CAST(l_shipdate AS VARCHAR) AS shipped, 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter
FROM lineitem WHERE month(l_shipdate) IN (1, 2, 3)""")
def report_sales_quarter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.month("l_shipdate").isin(1, 2, 3))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"), F.concat(F.lit("Q"), F.quarter("l_shipdate")).alias("quarter"))


@query("""SELECT p_name, sum(l_quantity) AS quantity, round(sum(l_quantity * l_extendedprice), 2) AS revenue, round(avg(l_extendedprice), 6) AS mean_price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY revenue DESC""")
def report_product_sales(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_name").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("revenue"), F.round(F.avg("l_extendedprice"), 6).alias("mean_price"))
    return g.orderBy(F.desc("revenue"), "p_name")


@query("""SELECT o_orderkey, l_linenumber, CAST(o_orderdate AS VARCHAR) AS ordered, o_custkey, o_totalprice, p_name, l_quantity, l_extendedprice FROM orders
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'""")
def report_sales_detail(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'")
    j = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.select("o_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"), "o_custkey", "o_totalprice", "p_name", "l_quantity", "l_extendedprice")


CUSTOMERS = "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def customers(spark: SparkSession, d: str, region: str | None) -> DataFrame:
    """Customers of a region, or all without one."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.where(F.lit(region is None) | (F.col("r_name") == F.lit(region))).select("c_custkey", "c_name", "n_name", "r_name")


@query(CUSTOMERS + " WHERE r_name = 'ASIA'")
def report_customer_list(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d, "ASIA")


@query(CUSTOMERS)
def report_customer_list_all(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d, None)


@query("SELECT p_partkey, p_name, p_size, p_retailprice, round(p_size * p_retailprice, 4) AS stock_value FROM part WHERE p_size > 0 ORDER BY stock_value DESC, p_partkey")
def report_inventory_value(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size > 0")
    return p.select("p_partkey", "p_name", "p_size", "p_retailprice", F.round(F.col("p_size") * F.col("p_retailprice"), 4).alias("stock_value")).orderBy(F.desc("stock_value"), "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_extendedprice, 4) AS revenue, CAST(l_shipdate AS VARCHAR) AS shipped FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber")
def report_sales_revenue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 4).alias("revenue"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"))


@query(f"SELECT report_id, 'DS' || query_id AS dataset, p_partkey, p_brand FROM {Q} JOIN part ON p_partkey = query_id WHERE {SOUND} AND query_id % 2 = 0")
def apply_report_filters(spark: SparkSession, d: str) -> DataFrame:
    """The filters that the reports' datasets declare, extracted from their files and run: field A is the part's key."""
    filters = reportxml.filters(reportxml.shred(reportxml.derived(spark, d)))
    rows = table(spark, d, "part").select("p_partkey", "p_brand")
    return measures.run_filters(rows, {"A": "p_partkey"}, filters).select("report_id", "dataset", "p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice > 950 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def apply_given_filters(spark: SparkSession, d: str) -> DataFrame:
    filters = [("p_size", "Between", (5, 20)), ("p_retailprice", "GreaterThan", (950,)), ("p_brand", "In", ("Brand#11", "Brand#12", "Brand#23"))]
    return measures.apply_filters(table(spark, d, "part"), filters).select("p_partkey", "p_brand", "p_size")


@query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in ("orders", "customer", "part", "lineitem")))
def validate_row_count(spark: SparkSession, d: str) -> DataFrame:
    return validation.row_counts({t: table(spark, d, t) for t in ("orders", "customer", "part", "lineitem")})


@query("SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS distinct_rows FROM orders")
def validate_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return validation.uniqueness(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0),
o AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'only_old' WHEN o.o_orderkey IS NULL THEN 'only_new' ELSE 'differs' END AS state,
o.v AS old_value, n.v AS new_value, n.v - o.v AS difference FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.v IS DISTINCT FROM n.v""")
def reconcile_datasets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    new = rows.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return validation.reconcile(rows.where("o_orderkey % 5 <> 0"), new, ["o_orderkey"], "o_totalprice")


PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS blanks, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM customer" for c in PROFILED))
def completeness_profile(spark: SparkSession, d: str) -> DataFrame:
    return validation.completeness(table(spark, d, "customer"), PROFILED)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def dataset_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderkey").limit(10).select("o_orderkey", "o_custkey", "o_totalprice")
