import math

import pytest
from pyspark.sql import functions as F

from reportmill.functions import dialects, features, rules
from reportmill.operators import graph, measures, nearest, pairs, reports, similarity, store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "purpose"), [("CustomerID", "date_filter"), ("ClientId", "customer_filter"), ("Vendor", "date_filter"), ("Region", "location_filter"), ("MinAmount", "general_filter")])
def test_parameter_purpose(spark, name, purpose):
    assert one(spark, rules.param_purpose(F.col("n")), n=name) == purpose


@pytest.mark.parametrize(("a", "b", "score"), [("Sales.Orders", "HR.Employee", 0.1), ("Sales.Orders", "Finance.Payment", 0.6), ("Sales.Orders", "Sales.Customer", 1.0)])
def test_domain_compatibility(spark, a, b, score):
    c = pairs.compatibility(F.array(rules.table_domain(F.col("a"))), F.array(rules.table_domain(F.col("b"))))
    assert one(spark, c, a=a, b=b) == pytest.approx(score)


@pytest.mark.parametrize(("a", "b", "score"), [([], [], 1), ([], ["a"], 0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, score):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(pairs.jaccard(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(score)
    assert df.select(pairs.jaccard(F.col("b"), F.col("a")).alias("x")).first().x == pytest.approx(score)


@pytest.mark.parametrize(("basic", "vector", "kept"), [(0.2, 0.7, True), (0.5, 0.5, True), (0.4, 0.5, False)])
def test_gate(spark, basic, vector, kept):
    assert one(spark, pairs.gate(F.col("b"), F.col("v")), b=basic, v=vector) is kept


def test_merge(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "r1 string, r2 string, score double")
    got = {(x.r1, x.r2): (x.score, x.origin) for x in reports.merged(rows(("a", "b", 90.0), ("a", "c", 90.0)), rows(("b", "a", 60.0), ("b", "a", 10.0), ("d", "e", 5.0))).collect()}
    assert got == {("a", "b"): (81.0, "both"), ("a", "c"): (90.0, "first"), ("d", "e"): (5.0, "second")}


def alone(spark, ids):
    return spark.createDataFrame([(i, i, 1) for i in ids], "report_id string, class_id string, copies long")


def paired(spark, *rows):
    return spark.createDataFrame([(*r[:2], 1, 1, 1, float(r[2])) for r in rows], "r1 string, r2 string, n1 long, n2 long, pairs long, overall double")


def test_clusters_and_savings(spark):
    p, m = paired(spark, ("a", "b", 90), ("b", "c", 85), ("d", "e", 80), ("f", "g", 79)), alone(spark, "abcdefg")
    got = {x.component: (x["size"], x.similarity, x.priority) for x in reports.cluster_table(p, m).collect()}
    assert got == {"a": (3, 87.5, "HIGH"), "d": (2, 80.0, "MEDIUM")}
    assert {x.component: x.report_id for x in reports.representatives(p, m).collect()} == {"a": "a", "d": "d"}
    cells = {x.report: dict(zip("abcdefg", x.cells)) for x in reports.matrix(p).collect()}
    assert cells["a"]["b"] == cells["b"]["a"] == 90.0 and cells["a"]["a"] == 100.0 and cells["a"]["g"] == 0.0 and list(map(len, cells.values())) == [7] * 7
    many = spark.range(250).selectExpr("id AS r1", "id + 1 AS r2", "50.0 AS overall")
    assert {len(x.cells) for x in reports.matrix(many).collect()} == {251}
    with pytest.raises(ValueError):
        reports.matrix(many, width=100)


@pytest.mark.parametrize(("sizes", "want"), [([3], (24, 12, 12, 900, 0.666667)), ([1], (8, 12, 0, 0, 0.0)), ([], (0, 0, 0, 0, 0.0)), ([4, 2], (48, 24, 24, 1800, 0.666667))])
def test_savings(spark, sizes, want):
    s = reports.savings(spark.createDataFrame([(str(n), n) for n in sizes], "component string, size long")).first()
    assert (s.single_hours, s.cluster_hours, s.saved_hours, s.saved_cost, s.ratio) == want


def test_priority(spark):
    rows = [("a", x, 90) for x in "bcd"] + [("b", "c", 60), ("e", "f", 95), ("g", "h", 40)]
    got = [(r.report_id, r.partners, r.priority) for r in reports.ranked_priority(paired(spark, *rows), alone(spark, "abcdefgh")).orderBy("place").collect()]
    assert got == [("a", 3, "HIGH"), ("b", 2, "MEDIUM"), ("c", 2, "MEDIUM"), ("e", 1, "MEDIUM"), ("f", 1, "MEDIUM"), ("d", 1, "MEDIUM"), ("g", 1, "LOW"), ("h", 1, "LOW")]


#: Report definitions as rows, with copies (5 and 6 of 1), a report of nothing (7), and every kind of part.
CATALOG = [(i, "n", "x") for i in range(1, 9)]
SOURCES = [(1, "Main", "Initial Catalog=A"), (2, "Main", "initial catalog=a"), (2, "Other", "x"), (3, "Main", "Initial Catalog=B"), (4, "Main", "Initial Catalog=A"), (8, "Main", "Initial Catalog=A")]
ITEMS = [(1, "t", "Table", "=Sum(Fields!Amount.Value)"), (2, "t", "Table", "=Sum(Fields!Amount.Value)"), (2, "u", "TextBox", "=Fields!Name.Value"), (3, "c", "Chart", "=Sum(Fields!Stock.Value)"), (3, "u", "TextBox", "=IIF(Fields!Stock.Value > 0, 1 + 1, 0)"),
         (4, "w", "TextBox", " ".join(f"Fields!F{i}.Value" for i in range(12))), (8, "t", "Table", "=Fields!Amount.Value - 2")]
GROUPS = [(1, "t", "row", "=Fields!Region.Value"), (2, "t", "row", "=Fields!Region.Value"), (2, "t", "column", "=Fields!Month.Value"), (3, "c", "category", "=Fields!A.Value")]
PARAMS = [(1, "StartDate", "x"), (2, "Customer", "x"), (2, "Region", "x"), (4, "Region", "x")]
QUERIES = [(1, ["sales.orders"], ["a.d >= '2020'"], "s1"), (1, ["sales.orders", "hr.staff"], [], "s2"), (2, ["sales.customer"], ["x = 5", "?"], "s3"), (3, ["dbo.stock"], [], "s4"), (8, ["sales.orders"], [], "s1")]


def a_catalogue(spark):
    copies = lambda rows: rows + [(i, *r[1:]) for i in (5, 6) for r in rows if r[0] == 1]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    return [make(CATALOG, "report_id long, report_name string, connect_string string"), make(copies(SOURCES), "report_id long, source_name string, connect_string string"), make(copies(ITEMS), "report_id long, item_name string, item_type string, expression string"),
            make(copies(GROUPS), "report_id long, item_name string, kind string, expression string"), make(copies(PARAMS), "report_id long, param_name string, data_type string"), make(copies(QUERIES), "report_id long, tables array<string>, conditions array<string>, signature string")]


def test_contexts(spark):
    c = {r.report_id: r for r in reports.contexts(*a_catalogue(spark)).collect()}
    assert c[1].sources == ["main:a"] and c[2].sources == ["main:a", "other:unknown_db"] and c[7].sources == []
    assert c[1].filters == ["d:greater_equal", "startdate:unknown"] and c[2].filters == ["customer:unknown", "region:unknown", "x:equals"]
    assert c[1].calculations == ["aggregation:SUM"] and c[3].calculations == ["conditional:CONDITIONAL"] and c[8].calculations == ["formula:ARITHMETIC"]
    assert [c[i].layout for i in (1, 2, 3, 4, 7)] == ["tabular_report", "matrix_report", "chart_report", "custom_report", "custom_report"]
    assert [c[i].purpose for i in (1, 2, 3, 4, 7)] == ["periodic_summary_report"] * 2 + ["custom_operational_report"] * 3  # "customer" holds "to", so report 2 has a date filter
    assert c[1].domain == "financial" and c[2].domain == "customer" and c[4].domain == "unknown" and c[1].groups == ["region"] and c[2].groups == ["month", "region"]
    assert c[1].domains == ["hr", "sales", "sales"] and c[1].class_key == c[5].class_key == c[6].class_key


def brute_pairs(rows, analyzed):
    over = lambda a, b: 100.0 if not a and not b else 100 * len(set(a) & set(b)) / len(set(a) | set(b))
    kin = {frozenset(p) for p in rules.RELATED}
    lists = {"sales": ("sales", "order", "invoice", "product", "customer"), "inventory": ("inventory", "stock", "warehouse", "item", "supplier"), "hr": ("employee", "staff", "department", "payroll", "hire")}

    def set_domain(tables):
        hits = {k: sum(w in " ".join(tables) for w in v) for k, v in lists.items()}
        return max(hits, key=hits.get) if any(hits.values()) else "unknown"

    out = {}
    for x in rows:
        for y in rows:
            if x.report_id >= y.report_id:
                continue
            listed = over(x.sources, y.sources)
            source = listed
            if x.domains and y.domains:
                if analyzed:
                    source = listed * 0.3 + 70 * sum(1.0 if p == q else 0.6 if frozenset((p, q)) in kin else 0.1 for p in x.domains for q in y.domains) / len(x.domains) / len(y.domains)
                else:
                    p, q, shared = set_domain(x.tables), set_domain(y.tables), over(x.tables, y.tables)
                    source = listed * 0.3 + shared * 0.7 if p == q or "unknown" in (p, q) else min(25, listed * 0.2 + shared * 0.2)
            terms = [over(x.fields, y.fields) * 1.5] if x.fields or y.fields else []
            terms += [25 if "unknown" in (x.domain, y.domain) else 85 if x.domain == y.domain else 5, 50 if x.layout == y.layout else 0, over(x.groups, y.groups)]
            d = {"source": source, "filters": over(x.filters, y.filters), "calculations": over(x.calculations, y.calculations), "parameters": over(x.purposes, y.purposes), "purpose": 100.0 * (x.purpose == y.purpose), "output": min(100, sum(terms) / len(terms))}
            total = 0.35 * d["purpose"] + 0.30 * source + 0.15 * d["filters"] + 0.15 * d["output"] + 0.03 * d["calculations"] + 0.02 * d["parameters"]
            if total > 30 + 1e-9:
                out[x.report_id, y.report_id] = (*(round(d[k], 6) for k in reports.DIMENSIONS), round(total, 5))
    return out


@pytest.mark.parametrize(("block", "analyzed"), [(500, True), (2, True), (1, False)])
def test_report_pairs_against_brute_force(spark, monkeypatch, block, analyzed):
    monkeypatch.setattr(reports, "BLOCK", block)
    c = reports.contexts(*a_catalogue(spark)).cache()
    of = {r.report_id: (r.class_id, r.copies) for r in reports.class_members(c).collect()}
    assert of[5] == of[6] == of[1] == (1, 3) and of[7] == (7, 1)
    got = {(r.r1, r.r2): r for r in reports.scored(c, analyzed=analyzed).collect()}
    want = brute_pairs(c.collect(), analyzed)
    full = {(i, j): got.get((min(of[i][0], of[j][0]), max(of[i][0], of[j][0]))) for i in of for j in of if i < j}
    assert {k: (*(round(v[d], 6) for d in reports.DIMENSIONS), round(v.overall, 5)) for k, v in full.items() if v} == want
    assert sum(r.pairs for r in got.values()) == len(want) and (1, 1) in got


def test_roll_ups_count_reports_not_classes(spark):
    """Two copies of one report and one other: classes a (3) and b (1)."""
    p = spark.createDataFrame([("a", "a", 3, 3, 3, 90.0), ("a", "b", 3, 1, 3, 60.0)], "r1 string, r2 string, n1 long, n2 long, pairs long, overall double")
    m = spark.createDataFrame([("a", "a", 3), ("a2", "a", 3), ("a3", "a", 3), ("b", "b", 1)], "report_id string, class_id string, copies long")
    assert {r.report_id: (r.partners, r.similarity) for r in reports.partners(p, m).collect()} == {"a": (3, 80.0), "a2": (3, 80.0), "a3": (3, 80.0), "b": (3, 60.0)}
    assert [(r.component, r["size"], r.similarity) for r in reports.cluster_table(p, m).collect()] == [("a", 3, 90.0)]
    assert {r.report_id for r in reports.clusters(p, m, 50).collect()} == {"a", "a2", "a3", "b"}


@pytest.mark.parametrize("heavy", [100, 2, 1, 0])
def test_structural_scores(spark, heavy):
    rows = [(1, "A", "x", "S", "i"), (1, "B", "y", "S", "j"), (2, "A", "x", "T", "k"), (2, "B", "z", "T", "j"), (3, "C", "x", "S", "m"), (4, "A", "q", "U", "n"), (5, "D", "w", "V", "o"), (6, "D", "w", "V", "o"), (7, "A", "q", "U", None), (8, "A", None, "U", None)]
    df = spark.createDataFrame(rows, "report_id long, dataset_name string, sql_text string, source_name string, item_name string")
    got = reports.structural(df, heavy).collect()
    of = {r.report_id: r.profile_id for r in reports.profile_members(df, heavy).collect()}
    near, wide = {(r.r1, r.r2): r.score for r in got if not r.profiles}, {(r.r1, r.r2): r for r in got if r.profiles}
    links = {}
    for i in range(1, 9):
        for j in range(i + 1, 9):
            profile = tuple(sorted((of[i], of[j]))) if i in of and j in of else None
            if (i, j) in near:
                links[i, j] = near[i, j]
            elif profile in wide:
                links[i, j] = wide[profile].score
    want = {}
    for i in range(1, 9):
        for j in range(i + 1, 9):
            x, y = ([r for r in rows if r[0] == k] for k in (i, j))
            common = lambda f: {f(r) for r in x} & {f(r) for r in y} - {None}  # noqa: E731, B023
            score = (40 + 30 * len(common(lambda r: r[2] and r[1:3])) if common(lambda r: r[1]) else 0) + (20 if common(lambda r: r[3]) else 0) + (10 if common(lambda r: r[4]) else 0)
            if score:
                want[i, j] = min(100, score)
    assert links == want and len(near) + sum(r.pairs for r in wide.values()) == len(want)


CASES = [
    (rules.query_shape, "select max(a) from b", "Basic Query"), (rules.query_shape, "select sum(a) from b join c", "Aggregation"), (rules.query_shape, "x join y where a = 1", "Join Query"), (rules.query_shape, "x where a = 1", "Basic Query"), (rules.query_shape, "x where a >= 1", "Filtered Query"),
    (rules.query_shape, "x where a between 1 and 2 order by b", "Filtered Query"), (rules.query_shape, "x where a = 1 order by b", "Sorted Query"), (rules.query_shape, "x group by b", "Grouped Query"), (rules.query_shape, "", "Basic Query"), (rules.query_shape, "count (x)", "Basic Query"),
    (rules.statement_type, " select 1", "SELECT"), (rules.statement_type, "CALL p()", "PROCEDURE"), (rules.statement_type, "{ call p }", "PROCEDURE"), (rules.statement_type, "exec p", "PROCEDURE"), (rules.statement_type, "create procedure p", "CREATE"), (rules.statement_type, "procedure p", "UNKNOWN"), (rules.statement_type, "with a as (select 1) select 2", "UNKNOWN"),
    (rules.param_filter_type, "StartDate", "date_range"), (rules.param_filter_type, "CustomerID", "date_range"), (rules.param_filter_type, "Region", "categorical"), (rules.param_filter_type, "Count", "categorical"),
    (rules.filter_kind, "a = @p", "parameter_date"), (rules.filter_kind, "x.a between 1 and 2", "date_range"), (rules.filter_kind, "MONTH(d) in (1)", "month_filter"), (rules.filter_kind, "year(d) = 2020", "year_filter"), (rules.filter_kind, "d >= '1'", "date_gte"), (rules.filter_kind, 'd<="1"', "date_lte"), (rules.filter_kind, "k in (1)", "in_list"),
    (rules.filter_kind, "k = 'v'", "equals_string"), (rules.filter_kind, "k like 'v'", "like_pattern"), (rules.filter_kind, "n > 1.5", "greater_than"), (rules.filter_kind, "n<3", "less_than"), (rules.filter_kind, "n = 3", "equals_number"), (rules.filter_kind, "n >= @p", "parameter_range"), (rules.filter_kind, "EXISTS x", "other"),
    (rules.filter_field, "x.Price BETWEEN 1 AND 2", "price"), (rules.filter_field, "MONTH(SaleDate) IN (1)", "saledate"), (rules.condition_type, "a LIKE 'x'", "pattern_match"), (rules.condition_type, "a > 1", "greater_than"), (rules.condition_type, "a < 1", "less_than"), (rules.condition_type, "a IN (1)", "in_list"),
    (rules.is_calculation, "=Sum(x)", True), (rules.is_calculation, "=Year(Fields!D.Value)", False), (rules.is_calculation, "=1+2", True), (rules.is_calculation, "a - b", False), (rules.is_calculation, "=IIF(a, b, c)", False), (rules.is_calculation, "=a/b", True),
    (rules.calculation_level, "=Sum(Fields!A.Value) + 1", "SUM"), (rules.calculation_level, "=avg( Fields!A.Value )", "AVG"), (rules.calculation_level, "=Fields!A.Value * 2", "ARITHMETIC"), (rules.calculation_level, "=IIF(1 > 0, 1 + 1, 2)", "CONDITIONAL"), (rules.calculation_level, '=Format(Fields!D.Value, "yyyy-MM")', "FORMAT"),
    (rules.calculation_level, "=Year(Fields!D.Value) - 1", "YEAR"), (rules.calculation_level, "=Month(Fields!D.Value) - 1", "MONTH"), (rules.calculation_level, "=Sum(1 + 2)", None), (rules.calculation_type, "=Max(Fields!A.Value)", "aggregation"), (rules.calculation_type, "Sum(Fields!A.Value)", None),
    (rules.field_domain, "ordered amount", "sales"), (rules.field_domain, "amount cost", "financial"), (rules.field_domain, "Email", "customer"), (rules.field_domain, "kpi", "analytics"), (rules.field_domain, "workflow", "operations"), (rules.field_domain, "campaign lead", "marketing"), (rules.field_domain, "region", "unknown"), (rules.field_domain, "salary stock item", "inventory"),
    (rules.table_set_domain, "sales.orders hr.staff", "sales"), (rules.table_set_domain, "warehouse item", "inventory"), (rules.table_set_domain, "budget", "financial"), (rules.table_set_domain, "dbo.ledger", "unknown"), (rules.table_set_domain, "manufacturing", "operations"),
    (rules.table_domain, "orderbook.dbo", "general"), (rules.table_domain, "Sales.Staff", "sales"), (rules.table_domain, "dbo.Staff", "hr"), (rules.table_domain, "customerdb.x.orders", "sales"), (rules.table_domain, "SalesReport", "sales"), (rules.table_domain, "Inventory.Stock", "product"),
    (rules.clean_file_name, "file_12_a_b.rdl", "a_b.rdl"), (rules.clean_file_name, "a_b.rdl", "a_b.rdl"), (rules.bare_file_name, "a_b_c.rdl", "b_c.rdl"), (rules.bare_file_name, "abc.rdl", "abc.rdl"),
]


def test_rules_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    by_rule = {}
    for i, (rule, _, _) in enumerate(CASES):
        by_rule.setdefault(rule, []).append(i)
    for rule, places in by_rule.items():
        got = {r.i: r.x for r in df.where(F.col("i").isin(places)).select("i", rule(F.col("t")).alias("x")).collect()}
        for i in places:
            assert got[i] == CASES[i][2], (rule.__name__, CASES[i][1], got[i])


@pytest.mark.parametrize(("counts", "purpose"), [((1, 1, 1, 1, 0), "periodic_summary_report"), ((1, 2, 0, 0, 11), "detailed_transactional_report"), ((0, 1, 2, 1, 20), "analytical_summary_report"), ((0, 0, 0, 0, 11), "master_data_report"), ((0, 1, 0, 0, 11), "custom_operational_report"), ((1, 1, 1, 0, 10), "custom_operational_report")])
def test_purpose(spark, counts, purpose):
    assert one(spark, rules.purpose(*map(F.col, "abcde")), **dict(zip("abcde", counts))) == purpose


@pytest.mark.parametrize(("text", "want"), [("a = @p AND b = @p2 OR c = @p", "a = @PARAM1 AND b = @PARAM2 OR c = @PARAM1"), ("x = $1 AND y = ?", "x = @PARAM1 AND y = @PARAM2"), ("@PARAM2 = @a", "@PARAM1 = @PARAM2")])
def test_parameterized(spark, text, want):
    assert one(spark, features.parameterized(F.col("t"), features.parameters(F.col("t"))), t=text) == want


def test_extracted_filters_are_run(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "xy")], "k long, name string")
    filters = [(1, "d", "=Fields!K.Value", "In", ["1", "3"]), (1, "d", "=Fields!N.Value", "Like", ["x%"]), (2, "e", "=Fields!K.Value", "GreaterThan", ["1"]), (3, "f", "=Fields!Other.Value", "Equal", ["1"]), (4, "g", "=Fields!K.Value", "Between", ["2", "9"])]
    got = measures.run_filters(rows, {"K": "k", "N": "name"}, spark.createDataFrame(filters, "report_id long, dataset string, expression string, operator string, values array<string>")).collect()
    assert sorted((r.report_id, r.k) for r in got) == [(1, 1), (1, 3), (2, 2), (2, 3), (4, 2), (4, 3)]


def test_components_of_a_long_path_and_no_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3), (1000, 999)], "a long, b long")
    got = {x.node: x.component for x in graph.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 999: 999, 1000: 999}
    assert graph.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("at", "valid"), [("2024-01-01 10:00:00", True), ("2024-01-01 09:59:59", False)])
def test_expiry(spark, at, valid):
    df = spark.createDataFrame([(at,)], "t string").select(F.to_timestamp("t").alias("t"))
    assert (store.expire(df, "t", F.lit("2024-01-02 10:00:00").cast("timestamp")).count() == 1) is valid
    assert store.expire(store.expire(df, "t", F.lit("2024-01-02 10:00:00").cast("timestamp")), "t", F.lit("2024-01-02 10:00:00").cast("timestamp")).count() == int(valid)


def test_connection(spark):
    c = rules.connection(F.col("c"))
    assert one(spark, c["server"], c="Data Source=X;Initial Catalog=Y") == "X"
    assert one(spark, c["database"], c="Data Source=X;Initial Catalog=Y") == "Y"
    assert one(spark, rules.database_name(F.col("c")), c="x") == "unknown_db"


def test_dialect_traps(spark):
    texts = ["SELECT @@VERSION", "SELECT 1", None, "SELECT 1"]
    got = dialects.detected(spark.createDataFrame([(t,) for t in texts], "q string"), "q").collect()
    assert len(got) == 4 and {(r.q, r.dialect) for r in got} >= {("SELECT @@VERSION", "T-SQL"), ("SELECT 1", "ANSI SQL")} and all(r.confidence == 0 for r in got if r.q == "SELECT 1")
    assert one(spark, dialects.normalize(F.col("q")), q="SELECT TOP 5 [a], ISNULL(b, 0) FROM `t`") == 'SELECT LIMIT 5 "a", COALESCE(b, 0) FROM "t"'


def test_query_features(spark):
    text = "SELECT o.Id, SUM(x.Amount) FROM [Sales].[Orders] o -- note FROM nowhere\nLEFT OUTER JOIN dbo.Lines x ON o.Id = x.Id WHERE x.d BETWEEN 1 AND 2 AND o.k = :p GROUP BY o.Id"
    r = features.with_features(spark.createDataFrame([(text,), (None,)], "sql_text string")).collect()
    assert r[0].tables == ["dbo.lines", "sales.orders"] and r[0].joins == ["LEFT"] and r[0].functions == ["SUM"] and r[0].parameters == [":p"] and r[0].grouped and r[0].aggregations == ["SUM", "GROUP BY"]
    assert r[1].tables == [] and r[1].complexity == 0
    df = spark.createDataFrame([(text,)], "q string").select(features.conditions(features.unquoted(features.strip_comments(F.col("q")))).alias("c"))
    assert df.first().c == ["x.d BETWEEN 1 AND 2", "o.k = :p"]


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.id1, r.id2) for r in similarity.near_duplicates(docs, "doc_id", "text", 0.6).collect()}
    sets = {}
    for i, w in docs.select("doc_id", similarity.words(F.col("text")).alias("w")).orderBy("doc_id").collect():
        if w:
            sets.setdefault(frozenset(w), i)
    rows = [(i, w) for w, i in sets.items()]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(x & y) / len(x | y) >= 0.6}
    assert got == want


def test_size_budget_keeps_the_newest(spark):
    rows = [(i, f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00", 10.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, t string, s double").withColumn("t", F.to_timestamp("t"))
    assert {r.k for r in store.within_budget(df, "s", "t", "k", 100.0).collect()} == set(range(32, 40))
    assert store.within_budget(df, "s", "t", "k", 1000.0).count() == 40


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("spread", [False, True])
def test_neighbours_by_blocks(spark, spread):
    """Exact neighbours, of the table's vectors and of groups of close ones that most blocks can leave out."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(60).collect()]
    if spread:
        rows = [(i, [1.0 if j == i % 6 else 0.02 * ((i * 7 + j * 3) % 5) for j in range(6)]) for i in range(90)] + [(91, [1.0] + [0.0] * 5), (92, [1.0] + [0.0] * 5), (93, [0.0] * 6), (94, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    some = [(i, v) for i, v in rows if v and any(v)]
    got = {(r.id, r.place): r.other for r in nearest.top_k_each(df, "vec_id", "embedding", 3, block=8).collect()}
    assert len(got) == 3 * len(some)
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    for i, _ in some:
        best = sorted((-round(cosine(vectors[i], vectors[j]), 9), j) for j, _ in some if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]
    for least in (0.3, 0.9):
        pairs = {(r.id1, r.id2): r.score for r in nearest.cosine_pairs(df, "vec_id", "embedding", least, block=8).collect()}
        want = {(i, j): cosine(vectors[i], vectors[j]) for i, _ in some for j, _ in some if i < j and cosine(vectors[i], vectors[j]) >= least}
        assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-9 for k in want)
    if spread:
        met = nearest.blocks_met(df, "vec_id", "embedding", 0.9, block=8).first()
        assert met.met < 0.6 * met.pairs


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert nearest.cosine_pairs(none, "vec_id", "embedding").collect() == [] and nearest.top_k_each(none, "vec_id", "embedding").collect() == []


def test_keyword_vector(spark):
    text = "SELECT a, sum(b) FROM Orders GROUP BY a"
    v = spark.createDataFrame([(text,), ("",)], "t string").select(similarity.keyword_vector(F.col("t")).alias("v")).collect()
    ones = {0, 1, 8, 20, 71, 80}
    ones.add(27) if "else" in text.lower() else None
    raw = [0.0] * 128
    for i in ones:
        raw[i] = 1.0
    raw[64], raw[65], raw[66], raw[67] = len(text) / 1000, len(text.split()) / 100, 1 / len(text), 1 / len(text)
    norm = math.sqrt(sum(x * x for x in raw))
    assert len(v[0].v) == 128 and all(abs(x - y / norm) < 1e-9 for x, y in zip(v[0].v, raw)) and v[1].v == [0.0] * 128
