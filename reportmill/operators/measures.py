"""Report measures on any fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reportmill.operators.shared import cut, numbered


#: Datasets without a filter for equal values that one block of questions holds.
FILTER_BLOCK = 1000


def basic(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, sum and average of value by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def share_rank(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of the grand total and dense rank: the place of a group's total among the distinct totals."""
    t = cut(df.groupBy(*by).agg(F.sum(value).alias("total")))
    places = numbered(t.select("total").distinct(), "place", F.desc("total")).withColumnRenamed("total", "ranked")
    every = F.lit(t.agg(F.sum("total")).first()[0])
    ranked = t.join(places, F.col("total").eqNullSafe(F.col("ranked")))
    return ranked.select(*by, F.round("total", 4).alias("total"), F.round(F.col("total") * 100 / every, 6).alias("share"), "place")


def by_month(df: DataFrame, date: str, value: str) -> DataFrame:
    """(year, month, total): the grain of the period measures."""
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.sum(value).alias("total"))


def to_date_totals(df: DataFrame, date: str, value: str) -> DataFrame:
    """Running total within the year, by month."""
    run = W.partitionBy("year").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return by_month(df, date, value).select("year", "month", F.round("total", 2).alias("total"), F.round(F.sum("total").over(run), 2).alias("year_to_date"))


def month_to_date(df: DataFrame, date: str, value: str) -> DataFrame:
    """Running total within the month, by day."""
    days = df.groupBy(F.to_date(date).alias("day")).agg(F.sum(value).alias("total"))
    run = W.partitionBy(F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.select(F.col("day").cast("string").alias("day"), F.round("total", 2).alias("total"), F.round(F.sum("total").over(run), 2).alias("month_to_date"))


def previous_period(df: DataFrame, date: str, value: str) -> DataFrame:
    """Month, the month before it and the growth; null where there is none, or it is zero. The window has a row a month."""
    before = F.lag("total").over(W.orderBy("year", "month"))
    t = by_month(df, date, value).withColumn("before", before)
    return t.select("year", "month", F.round("total", 2).alias("total"), F.round("before", 2).alias("previous"), F.round((F.col("total") - F.col("before")) / F.nullif("before", F.lit(0)), 8).alias("growth"))


def apply_filters(df: DataFrame, filters: Sequence[tuple[str, str, Sequence]]) -> DataFrame:
    """Rows of df that pass every (field, operator, values): the filters of a report's dataset, run against its rows."""
    def predicate(field: str, operator: str, values: Sequence) -> Column:
        c = F.col(field)
        return {
            "Equal": lambda: c == values[0], "NotEqual": lambda: c != values[0], "GreaterThan": lambda: c > values[0], "GreaterThanOrEqual": lambda: c >= values[0],
            "LessThan": lambda: c < values[0], "LessThanOrEqual": lambda: c <= values[0], "Between": lambda: c.between(*values), "In": lambda: c.isin(*values), "Like": lambda: c.like(values[0]),
        }[operator]()
    for f in filters:
        df = df.where(predicate(*f))
    return df


def run_filters(rows: DataFrame, fields: dict[str, str], filters: DataFrame) -> DataFrame:
    """(report_id, dataset, columns of rows): the rows that pass every filter (report_id, dataset, expression, operator, values)
    of a dataset. An expression names a field as =Fields!Name.Value; fields says which column that is.

    Filters that ask for equal values, most of them, meet the rows by an equi-join; a dataset's others are tested on what
    is left. Datasets without such a filter are a stated set of questions to all rows, put in blocks of FILTER_BLOCK.
    Unknown fields match nothing.
    """
    f = filters.select("report_id", "dataset", F.regexp_extract("expression", r"Fields!(\w+)\.Value", 1).alias("field"), "operator", "values")
    first = F.col("values")[0]
    one = F.struct("field", "operator", "values", F.when(F.col("operator") == "Equal", F.array(first)).when(F.col("operator") == "In", F.col("values")).alias("wanted"))
    sets = f.groupBy("report_id", "dataset").agg(F.collect_list(one).alias("all"))
    lead = F.get(F.filter("all", lambda x: x["wanted"].isNotNull()), F.lit(0))
    sets = sets.withColumn("lead", lead)
    value = lambda field: F.coalesce(*(F.when(field == k, F.col(c).cast("string")) for k, c in fields.items()), F.lit(None).cast("string"))

    def passes(x: Column) -> Column:
        v, n, low = value(x["field"]), value(x["field"]).cast("double"), x["values"][0]
        number = low.cast("double")
        compare = {"Equal": v == low, "NotEqual": v != low, "GreaterThan": n > number, "GreaterThanOrEqual": n >= number, "LessThan": n < number, "LessThanOrEqual": n <= number,
                   "Between": n.between(number, F.get(x["values"], F.lit(1)).cast("double")), "In": F.array_contains(x["values"], v), "Like": F.expr("true") & v.isNotNull() & F.call_function("like", v, low)}
        out = F.lit(False)
        for name, test in compare.items():
            out = F.when(x["operator"] == name, test).otherwise(out)
        return F.coalesce(out, F.lit(False))

    led = sets.where("lead IS NOT NULL").withColumn("want", F.explode(F.array_distinct("lead.wanted")))
    tall = rows.withColumn("_of", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in fields.items()))))
    met = led.join(tall, (F.col("lead.field") == F.col("_of.field")) & (F.col("want") == F.col("_of.value")))
    alone = cut(sets.where("lead IS NULL"))
    blocks = -(-alone.count() // FILTER_BLOCK)
    alone = alone.withColumn("_block", F.pmod(F.xxhash64("report_id", "dataset"), F.lit(max(1, blocks))).cast("int"))
    free = alone.join(rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1)))), "_block")
    every = met.select("report_id", "dataset", "all", *rows.columns).unionByName(free.select("report_id", "dataset", "all", *rows.columns))
    return every.where(F.forall("all", passes)).drop("all")
