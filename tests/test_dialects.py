"""Every sign of every dialect on a text made by hand, and texts that look like it and are not."""

from pyspark.sql import functions as F

from reportmill.functions import dialects as D

TEXTS = {
    "T-SQL": {
        "variables": "declare @x int", "assignment": "set @x = 1", "globals": "select @@rowcount", "execute": "execute p", "system procedures": "sp_help", "isnull": "isnull (a, 0)", "date arithmetic": "datediff(day, a, b)", "getdate": "getdate()", "top": "top 5", "output": "output inserted.id",
        "merge": "merge into t", "brackets": "[my table]", "try catch": "begin try x end try begin catch", "raiserror": "raiserror('x')",
    },
    "PL/SQL": {
        "declare block": "x declare ", "begin end": "begin null; end ;", "exception": "exception when others", "cursor": "cursor c is", "loop": "end loop", "if then": "if a then b end if", "for loop": "for i in 1..3 loop", "procedures": "function f", "packages": "pkg_sales.run", "nvl": "nvl2(a, b, c)", "sysdate": "sysdate",
        "dual": "from dual", "rownum": "rownum < 5", "connect by": "connect  by prior",
    },
    "PostgreSQL": {
        "placeholders": "a = $1", "dollar quotes": "$body$", "returning": "returning id", "cast": "a::int", "series": "generate_series(1, 3)", "arrays": "array[1]", "unnest": "unnest(a)", "coalesce": "coalesce(a, b)", "extract": "extract(year from d)", "on conflict": "on conflict do nothing",
        "recursive": "with recursive t", "ilike": "a ilike 'x'", "tablesample": "tablesample system",
    },
    "MySQL": {
        "backticks": "`a b`", "limit": "limit 5", "offset": "offset 5", "ifnull": "ifnull(a, 0)", "concat": "concat(a, b)", "date format": "date_format(d, 'x')", "now": "now()", "replace into": "replace into t", "insert ignore": "insert ignore into t", "on duplicate key": "on duplicate key update",
        "straight join": "straight_join", "force index": "force index (i)",
    },
    "SQLite": {"autoincrement": "autoincrement", "pragma": "pragma x", "attach": "attach database 'x'", "detach": "detach database x", "vacuum": "vacuum", "reindex": "reindex", "analyze": "analyze t", "if not exists": "create table if not exists t"},
    "DB2": {"fetch first": "fetch first 5 rows only", "uncommitted read": "with ur", "optimize for": "optimize for 1 row", "nextval": "values nextval for s", "generated": "generated always", "concat operator": "concat operator ||"},
}
PLAIN = ("select a from b", "declared @x", "topmost 5", "looping", "nowhere()", "isnullable", "limits 5", "mergers", "arrays", "cursory", "dually", "vacuumed", "")


def test_every_sign_has_its_text(spark):
    rows = [(d, n, t) for d, signs in TEXTS.items() for n, t in signs.items()]
    assert {(d, n) for d, n, _ in rows} == {(d, n) for d, signs in D.SIGNS.items() for _, _, n in signs}
    df = spark.createDataFrame(rows, "d string, n string, t string")
    for r in df.withColumn("s", D.signs(F.col("t"))).collect():
        assert f"{r.d} {r.n}" in r.s, (r.t, r.s)
    weight = {(d, n): w for d, signs in D.SIGNS.items() for w, _, n in signs}
    for r in df.select("d", "n", *(v.alias(f"s{i}") for i, v in enumerate(D.scores(F.col("t")).values()))).collect():
        assert r[f"s{list(D.SIGNS).index(r.d)}"] >= weight[r.d, r.n]


def test_plain_texts_have_none(spark):
    df = spark.createDataFrame([(t,) for t in PLAIN], "t string")
    assert {r.t: r.s for r in df.withColumn("s", D.signs(F.col("t"))).collect()} == dict.fromkeys(PLAIN, [])


def test_a_strong_sign_lifts_the_share(spark):
    rows = [("select @@version from `t` limit 5",), ("select `a` from t limit 1",), ("select a",)]
    got = {r.t: (r.dialect, r.confidence) for r in D.detected(spark.createDataFrame(rows, "t string"), "t").collect()}
    assert got["select a"] == ("ANSI SQL", 0.0) and got["select `a` from t limit 1"] == ("MySQL", 1.0)
    assert got["select @@version from `t` limit 5"] == ("MySQL", min(1.0, round(17 / 27 * 1.2, 6)))
