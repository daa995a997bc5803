"""Report definitions in XML: a schema, the shredder, and scans of its parts.

from_xml reads every schema year alike, as it ignores the default namespace, and puts a broken text into `_corrupt` instead
of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import features, rules
from reportmill.sources import reportfiles
from reportmill.sources.corpus import load

_TEXTBOX = "STRUCT<_Name: STRING, Value: STRING>"
_GROUP = "Group: STRUCT<_Name: STRING, GroupExpressions: STRUCT<GroupExpression: ARRAY<STRING>>>"


def _members(depth: int) -> str:
    """Members of a hierarchy, which nest."""
    below = f", TablixMembers: STRUCT<TablixMember: {_members(depth - 1)}>" if depth > 1 else ""
    return f"ARRAY<STRUCT<{_GROUP}{below}>>"


#: How deep groups of a table may be nested.
DEPTH = 4
_ITEMS = f"""STRUCT<
 Tablix: ARRAY<STRUCT<_Name: STRING, DataSetName: STRING,
  TablixBody: STRUCT<TablixRows: STRUCT<TablixRow: ARRAY<STRUCT<TablixCells: STRUCT<TablixCell: ARRAY<STRUCT<CellContents: STRUCT<Textbox: {_TEXTBOX}>>>>>>>>,
  TablixColumnHierarchy: STRUCT<TablixMembers: STRUCT<TablixMember: {_members(DEPTH)}>>,
  TablixRowHierarchy: STRUCT<TablixMembers: STRUCT<TablixMember: {_members(DEPTH)}>>>>,
 Chart: ARRAY<STRUCT<_Name: STRING,
  ChartCategoryHierarchy: STRUCT<ChartMembers: STRUCT<ChartMember: ARRAY<STRUCT<{_GROUP}>>>>,
  ChartData: STRUCT<ChartSeriesCollection: STRUCT<ChartSeries: ARRAY<STRUCT<_Name: STRING, Type: STRING, ChartDataPoints: STRUCT<ChartDataPoint: STRUCT<ChartDataPointValues: STRUCT<Y: STRING>>>>>>>>>,
 Textbox: ARRAY<{_TEXTBOX}>>"""
SCHEMA = " ".join(f"""STRUCT<
 DataSources: STRUCT<DataSource: ARRAY<STRUCT<_Name: STRING, ConnectionProperties: STRUCT<DataProvider: STRING, ConnectString: STRING, IntegratedSecurity: STRING>>>>,
 DataSets: STRUCT<DataSet: ARRAY<STRUCT<_Name: STRING,
  Query: STRUCT<DataSourceName: STRING, CommandText: STRING, CommandType: STRING, QueryParameters: STRUCT<QueryParameter: ARRAY<STRUCT<_Name: STRING, Value: STRING>>>>,
  Fields: STRUCT<Field: ARRAY<STRUCT<_Name: STRING, DataField: STRING, Value: STRING, `rd:TypeName`: STRING>>>,
  Filters: STRUCT<Filter: ARRAY<STRUCT<FilterExpression: STRING, Operator: STRING, FilterValues: STRUCT<FilterValue: ARRAY<STRING>>>>>>>>,
 Body: STRUCT<ReportItems: {_ITEMS}>, ReportSections: STRUCT<ReportSection: STRUCT<Body: STRUCT<ReportItems: {_ITEMS}>>>,
 ReportParameters: STRUCT<ReportParameter: ARRAY<STRUCT<_Name: STRING, DataType: STRING, AllowBlank: STRING, MultiValue: STRING, Prompt: STRING, DefaultValue: STRUCT<Values: STRUCT<Value: ARRAY<STRING>>>>>>,
 _corrupt: STRING>""".split())
# Declared types and ours.
TYPES = {"System.Int32": "INT", "System.Int16": "SMALLINT", "System.Double": "DOUBLE", "System.Decimal": "DECIMAL(19,4)", "System.String": "STRING", "System.DateTime": "TIMESTAMP"}


def scan_files(spark: SparkSession, folder: str, glob: str = "*.rdl") -> DataFrame:
    """(path, modificationTime, length, content, error) of the report files below folder."""
    reportfiles.register(spark)
    return spark.read.format("report_files").option("glob", glob).load(folder)


def write_files(reports: DataFrame, folder: str) -> None:
    """One .rdl file a row of (report_id, content), in a folder of its report."""
    reportfiles.register(reports.sparkSession)
    reports.select("report_id", "content").repartition("report_id").write.format("report_folders").option("by", "report_id").option("kind", "rdl").mode("append").save(folder)


def stream_files(spark: SparkSession, folder: str, glob: str = "*.rdl") -> DataFrame:
    """The same as a stream: files are rows once they arrive."""
    reportfiles.register(spark)
    return spark.readStream.format("report_files").option("glob", glob).load(folder)


def shred(reports: DataFrame, content: str = "content") -> DataFrame:
    """reports with `r`, the nested report, and the schema year of its namespace."""
    parsed = F.from_xml(F.col(content), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return reports.withColumn("year", F.regexp_extract(content, r"/(\d{4})/\d\d/reportdefinition", 1)).withColumn("r", parsed)


def broken(shredded: DataFrame) -> DataFrame:
    return shredded.where("r IS NULL OR r._corrupt IS NOT NULL")


def sound(shredded: DataFrame) -> DataFrame:
    return shredded.where("r._corrupt IS NULL AND r IS NOT NULL")


def data_sources(shredded: DataFrame) -> DataFrame:
    t = sound(shredded).select("report_id", F.inline("r.DataSources.DataSource"))
    return t.select("report_id", F.col("_Name").alias("name"), "ConnectionProperties.DataProvider", "ConnectionProperties.ConnectString", "ConnectionProperties.IntegratedSecurity").toDF("report_id", "name", "provider", "connect_string", "integrated")


def _datasets(shredded: DataFrame) -> DataFrame:
    return sound(shredded).select("report_id", F.explode("r.DataSets.DataSet").alias("d"))


def datasets(shredded: DataFrame) -> DataFrame:
    q = F.col("d.Query")
    return _datasets(shredded).select("report_id", F.col("d._Name").alias("name"), q["DataSourceName"].alias("source"), q["CommandText"].alias("sql_text"), F.coalesce(q["CommandType"], F.lit("Text")).alias("command_type"))


def datasets_with_sources(shredded: DataFrame) -> DataFrame:
    """Datasets with the provider and connect string of their source, which is one of their own report: nothing is joined."""
    t = sound(shredded).select("report_id", F.col("r.DataSources.DataSource").alias("sources"), F.explode("r.DataSets.DataSet").alias("d"))
    t = t.select("report_id", F.col("d._Name").alias("name"), F.explode_outer(F.filter("sources", lambda s: s["_Name"] == F.col("d.Query.DataSourceName"))).alias("s"))
    return t.select("report_id", "name", F.col("s.ConnectionProperties.DataProvider").alias("provider"), F.col("s.ConnectionProperties.ConnectString").alias("connect_string"))


def query_parameters(shredded: DataFrame) -> DataFrame:
    t = _datasets(shredded).select("report_id", F.col("d._Name").alias("dataset"), F.explode("d.Query.QueryParameters.QueryParameter").alias("p"))
    return t.select("report_id", "dataset", F.col("p._Name").alias("name"), F.col("p.Value").alias("value"))


def fields(shredded: DataFrame) -> DataFrame:
    t = _datasets(shredded).select("report_id", F.col("d._Name").alias("dataset"), F.explode("d.Fields.Field").alias("f"))
    declared, kind = F.col("f.`rd:TypeName`"), F.lit(None).cast("string")
    for k, v in TYPES.items():
        kind = F.when(declared == k, v).otherwise(kind)
    return t.select("report_id", "dataset", F.col("f._Name").alias("name"), F.col("f.DataField").alias("data_field"), kind.alias("data_type"), F.col("f.Value").isNotNull().alias("is_calculated"), F.col("f.Value").alias("expression"))


def filters(shredded: DataFrame) -> DataFrame:
    t = _datasets(shredded).select("report_id", F.col("d._Name").alias("dataset"), F.explode("d.Filters.Filter").alias("f"))
    return t.select("report_id", "dataset", F.col("f.FilterExpression").alias("expression"), F.col("f.Operator").alias("operator"), F.col("f.FilterValues.FilterValue").alias("values"))


def parameters(shredded: DataFrame) -> DataFrame:
    t = sound(shredded).select("report_id", F.explode("r.ReportParameters.ReportParameter").alias("p"))
    yes = lambda c: F.coalesce(F.lower(F.col(c)) == "true", F.lit(False))
    return t.select("report_id", F.col("p._Name").alias("name"), F.coalesce("p.DataType", F.lit("String")).alias("data_type"), yes("p.AllowBlank").alias("blank"), yes("p.MultiValue").alias("multi"), F.coalesce("p.DefaultValue.Values.Value", F.array().cast("array<string>")).alias("defaults"))


def _items() -> Column:
    return F.coalesce("r.Body.ReportItems", "r.ReportSections.ReportSection.Body.ReportItems")


def items(shredded: DataFrame) -> DataFrame:
    """Tables, charts and text boxes as one set."""
    t = sound(shredded).select("report_id", _items().alias("i"))
    none = F.array().cast("array<struct<item_name:string,item_type:string>>")
    part = lambda c, kind: F.coalesce(F.transform(f"i.{c}", lambda x: F.struct(x["_Name"].alias("item_name"), F.lit(kind).alias("item_type"))), none)
    return t.select("report_id", F.inline(F.concat(part("Tablix", "Table"), part("Chart", "Chart"), part("Textbox", "TextBox"))))


def _tables(shredded: DataFrame) -> DataFrame:
    return sound(shredded).select("report_id", _items().alias("i")).select("report_id", F.explode("i.Tablix").alias("t"))


def table_columns(shredded: DataFrame) -> DataFrame:
    t = _tables(shredded).select("report_id", F.col("t._Name").alias("item_name"), F.explode("t.TablixBody.TablixRows.TablixRow").alias("row"))
    return t.select("report_id", "item_name", F.explode("row.TablixCells.TablixCell").alias("c")).select("report_id", "item_name", F.col("c.CellContents.Textbox._Name").alias("column_name"), F.col("c.CellContents.Textbox.Value").alias("expression"))


def _groups(hierarchy: str) -> Column:
    """The groups of a hierarchy, of all depths."""
    level, found = F.col(f"{hierarchy}.TablixMembers.TablixMember"), []
    for depth in range(DEPTH):
        found.append(F.coalesce(F.transform(level, lambda m: m["Group"]), F.array()))
        if depth < DEPTH - 1:
            level = F.flatten(F.transform(level, lambda m: F.coalesce(m["TablixMembers"]["TablixMember"], F.array())))
    return F.filter(F.concat(*found), lambda g: g.isNotNull())


def table_groups(shredded: DataFrame) -> DataFrame:
    """(report_id, item_name, kind, group_name, expressions): row and column groups of tables."""
    sides = F.concat(*(F.transform(_groups(f"t.Tablix{side}Hierarchy"), lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("g"))) for side, kind in (("Row", "row"), ("Column", "column"))))
    t = _tables(shredded).select("report_id", F.col("t._Name").alias("item_name"), F.inline(sides))
    return t.select("report_id", "item_name", "kind", F.col("g._Name").alias("group_name"), F.concat_ws(",", "g.GroupExpressions.GroupExpression").alias("expressions"))


def layouts(shredded: DataFrame) -> DataFrame:
    """(report_id, layout) by what a report shows."""
    t = sound(shredded).select("report_id", _items().alias("i"))
    across = F.size(F.filter("i.Tablix", lambda x: F.exists(F.coalesce(x["TablixColumnHierarchy"]["TablixMembers"]["TablixMember"], F.array()), lambda m: m["Group"].isNotNull() | F.exists(F.coalesce(m["TablixMembers"]["TablixMember"], F.array()), lambda n: n["Group"].isNotNull()))))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return t.select("report_id", rules.layout(size("i.Chart"), F.coalesce(across, F.lit(0)), size("i.Tablix")).alias("layout"))


def chart_series(shredded: DataFrame) -> DataFrame:
    t = sound(shredded).select("report_id", _items().alias("i")).select("report_id", F.explode("i.Chart").alias("c"))
    s = t.select("report_id", F.col("c._Name").alias("item_name"), F.concat_ws(",", F.flatten("c.ChartCategoryHierarchy.ChartMembers.ChartMember.Group.GroupExpressions.GroupExpression")).alias("categories"), F.explode("c.ChartData.ChartSeriesCollection.ChartSeries").alias("s"))
    return s.select("report_id", "item_name", "categories", F.col("s._Name").alias("series"), F.coalesce("s.Type", F.lit("Column")).alias("kind"), F.col("s.ChartDataPoints.ChartDataPoint.ChartDataPointValues.Y").alias("expression"))


def queries(shredded: DataFrame) -> DataFrame:
    """Query texts that are not empty, with their parameters."""
    q = datasets(shredded).withColumn("sql_text", F.trim("sql_text")).where("sql_text <> ''")
    return q.select("report_id", "name", "sql_text", F.concat_ws(",", features.parameters(F.col("sql_text"))).alias("parameters"))


def _escaped(c: str | Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, content): the derived corpora written as report definitions; every fiftieth is cut off in the middle."""
    x = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    glue = lambda c, order: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), c.alias("x")))), lambda s: s["x"]))
    c = F.col
    value = F.when(c("query_id") % 2 == 0, x('<Filters><Filter><FilterExpression>=Fields!A.Value</FilterExpression><Operator>Equal</Operator><FilterValues><FilterValue>', c("query_id").cast("string"), "</FilterValue><FilterValue>x</FilterValue></FilterValues></Filter></Filters>")).otherwise("")
    q = load(spark, sf_dir, "report_query").groupBy("report_id").agg(glue(x(
        '<DataSet Name="DS', c("query_id").cast("string"), '"><Query><DataSourceName>Main</DataSourceName><CommandText> ', _escaped(c("sql_text")), " </CommandText>",
        F.when(c("query_id") % 3 == 0, '<QueryParameters><QueryParameter Name="@p"><Value>=Parameters!p.Value</Value></QueryParameter></QueryParameters>').otherwise(""),
        '</Query><Fields><Field Name="A"><DataField>A</DataField><rd:TypeName>System.Int32</rd:TypeName></Field>', F.when(c("query_id") % 5 == 0, '<Field Name="B"><Value>=Fields!A.Value * 2</Value></Field>').otherwise(""), "</Fields>", value, "</DataSet>",
    ), "query_id").alias("q"))
    box = x('<Textbox Name="', c("item_name"), '"><Value>', _escaped("expression"), "</Value></Textbox>")
    group = lambda kind, name: F.coalesce(x(f'<Group Name="{name}', c("item_name"), '"><GroupExpressions><GroupExpression>', c(kind), "</GroupExpression></GroupExpressions></Group>"), F.lit(""))
    tablix = x('<Tablix Name="', c("item_name"), '"><TablixBody><TablixRows><TablixRow><TablixCells><TablixCell><CellContents>', box, "</CellContents></TablixCell></TablixCells></TablixRow></TablixRows></TablixBody><TablixColumnHierarchy><TablixMembers><TablixMember>", group("column", "c_"), "</TablixMember></TablixMembers></TablixColumnHierarchy><TablixRowHierarchy><TablixMembers><TablixMember>", group("row", "g_"), "<TablixMembers><TablixMember/></TablixMembers></TablixMember></TablixMembers></TablixRowHierarchy></Tablix>")
    chart = x('<Chart Name="', c("item_name"), '"><ChartCategoryHierarchy><ChartMembers><ChartMember><Group Name="c"><GroupExpressions><GroupExpression>=Fields!A.Value</GroupExpression></GroupExpressions></Group></ChartMember></ChartMembers></ChartCategoryHierarchy><ChartData><ChartSeriesCollection><ChartSeries Name="s">', F.when(F.length("item_name") % 2 == 0, "<Type>Line</Type>").otherwise(""), "<ChartDataPoints><ChartDataPoint><ChartDataPointValues><Y>", _escaped("expression"), "</Y></ChartDataPointValues></ChartDataPoint></ChartDataPoints></ChartSeries></ChartSeriesCollection></ChartData></Chart>")
    named = load(spark, sf_dir, "report_group").groupBy("report_id", "item_name").agg(*(F.max(F.when(c("kind") == k, c("expression"))).alias(k) for k in ("row", "column")))
    i = load(spark, sf_dir, "report_item").join(named, ["report_id", "item_name"], "left").groupBy("report_id").agg(glue(F.when(c("item_type") == "Table", tablix).when(c("item_type") == "Chart", chart).otherwise(box), "item_name").alias("i"))
    p = load(spark, sf_dir, "report_param").groupBy("report_id").agg(glue(x('<ReportParameter Name="', c("param_name"), '"><DataType>', c("data_type"), "</DataType>", F.when(c("data_type") == "String", "<AllowBlank>true</AllowBlank>").otherwise("<DefaultValue><Values><Value>1</Value><Value>2</Value></Values></DefaultValue>"), "</ReportParameter>"), "param_name").alias("p"))
    j = load(spark, sf_dir, "report_catalog").join(q, "report_id").join(i, "report_id").join(p, "report_id", "left")
    body = x("<Body><ReportItems>", c("i"), "</ReportItems></Body>")
    text = x(
        '<Report xmlns="http://schemas.microsoft.com/sqlserver/reporting/', c("schema_year"), '/01/reportdefinition" xmlns:rd="http://schemas.microsoft.com/SQLServer/reporting/reportdesigner"><DataSources><DataSource Name="Main"><ConnectionProperties><DataProvider>',
        c("provider"), "</DataProvider><ConnectString>", c("connect_string"), "</ConnectString></ConnectionProperties></DataSource></DataSources><DataSets>", c("q"), "</DataSets>",
        F.when(c("schema_year") == "2016", x("<ReportSections><ReportSection>", body, "</ReportSection></ReportSections>")).otherwise(body), F.coalesce(x("<ReportParameters>", c("p"), "</ReportParameters>"), F.lit("")), "</Report>",
    )
    cut_off = F.expr("substring(content, 1, length(content) div 2)")
    return j.withColumn("content", text).select("report_id", F.when(c("report_id") % 50 == 49, cut_off).otherwise(c("content")).alias("content"))
