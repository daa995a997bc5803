"""Signs of SQL dialects in a query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dialect, then weight, pattern on upper-case text, and sign; they decide the scores.
SIGNS: dict[str, tuple[tuple[int, str, str], ...]] = {
    "T-SQL": (
        (10, r"\bDECLARE\s+@\w+", "variables"), (8, r"\bSET\s+@\w+", "assignment"), (10, r"@@\w+", "globals"), (6, r"\bEXEC\b|\bEXECUTE\b", "execute"), (8, r"\bSP_\w+", "system procedures"),
        (7, r"\bISNULL\s*\(", "isnull"), (8, r"\bDATEADD\s*\(|\bDATEDIFF\s*\(", "date arithmetic"), (9, r"\bGETDATE\s*\(\)", "getdate"), (7, r"\bTOP\s+\d+", "top"), (8, r"\bOUTPUT\b", "output"),
        (6, r"\bMERGE\b", "merge"), (5, r"\[[\w\s]+\]", "brackets"), (9, r"\bTRY\b.*\bCATCH\b", "try catch"), (8, r"\bRAISERROR\b", "raiserror"),
    ),
    "PL/SQL": (
        (8, r"\bDECLARE\s*\z", "declare block"), (10, r"\bBEGIN\b.*\bEND\s*;", "begin end"), (10, r"\bEXCEPTION\b", "exception"), (9, r"\bCURSOR\b", "cursor"), (8, r"\bLOOP\b|\bEND\s+LOOP\b", "loop"),
        (8, r"\bIF\b.*\bTHEN\b.*\bEND\s+IF\b", "if then"), (8, r"\bFOR\b.*\bIN\b.*\bLOOP\b", "for loop"), (9, r"\bPROCEDURE\b|\bFUNCTION\b", "procedures"), (7, r"\bPKG_\w+", "packages"),
        (8, r"\bNVL\s*\(|\bNVL2\s*\(", "nvl"), (8, r"\bSYSDATE\b", "sysdate"), (9, r"\bDUAL\b", "dual"), (8, r"\bROWNUM\b", "rownum"), (9, r"\bCONNECT\s+BY\b", "connect by"),
    ),
    "PostgreSQL": (
        (10, r"\$\d+", "placeholders"), (9, r"\$\w+\$", "dollar quotes"), (8, r"\bRETURNING\b", "returning"), (7, r"::", "cast"), (9, r"\bGENERATE_SERIES\s*\(", "series"), (8, r"\bARRAY\[", "arrays"),
        (8, r"\bUNNEST\s*\(", "unnest"), (6, r"\bCOALESCE\s*\(", "coalesce"), (6, r"\bEXTRACT\s*\(", "extract"), (9, r"\bON\s+CONFLICT\b", "on conflict"), (8, r"\bWITH\s+RECURSIVE\b", "recursive"),
        (8, r"\bILIKE\b", "ilike"), (7, r"\bTABLESAMPLE\b", "tablesample"),
    ),
    "MySQL": (
        (9, r"`[\w\s]+`", "backticks"), (8, r"\bLIMIT\s+\d+", "limit"), (6, r"\bOFFSET\s+\d+", "offset"), (8, r"\bIFNULL\s*\(", "ifnull"), (6, r"\bCONCAT\s*\(", "concat"), (8, r"\bDATE_FORMAT\s*\(", "date format"),
        (7, r"\bNOW\s*\(\)", "now"), (9, r"\bREPLACE\s+INTO\b", "replace into"), (8, r"\bINSERT\s+IGNORE\b", "insert ignore"), (9, r"\bON\s+DUPLICATE\s+KEY\b", "on duplicate key"), (8, r"\bSTRAIGHT_JOIN\b", "straight join"), (7, r"\bFORCE\s+INDEX\b", "force index"),
    ),
    "SQLite": (
        (9, r"\bAUTOINCREMENT\b", "autoincrement"), (10, r"\bPRAGMA\b", "pragma"), (9, r"\bATTACH\s+DATABASE\b", "attach"), (9, r"\bDETACH\s+DATABASE\b", "detach"), (8, r"\bVACUUM\b", "vacuum"), (7, r"\bREINDEX\b", "reindex"),
        (6, r"\bANALYZE\b", "analyze"), (5, r"\bIF\s+NOT\s+EXISTS\b", "if not exists"),
    ),
    "DB2": (
        (9, r"\bFETCH\s+FIRST\s+\d+\s+ROWS?\s+ONLY\b", "fetch first"), (8, r"\bWITH\s+UR\b", "uncommitted read"), (8, r"\bOPTIMIZE\s+FOR\s+\d+\s+ROWS?\b", "optimize for"), (9, r"\bVALUES\s+NEXTVAL\s+FOR\b", "nextval"),
        (7, r"\bGENERATED\s+ALWAYS\b", "generated"), (6, r"\bCONCAT\s+OPERATOR\s+\|\|", "concat operator"),
    ),
}
# Signs that make a dialect certain.
STRONG = {"T-SQL": r"@@\w+|\bDECLARE\s+@\w+", "PL/SQL": r"\bBEGIN\b.*\bEXCEPTION\b|\bCURSOR\b", "PostgreSQL": r"\$\d+|\$\w+\$", "MySQL": r"`\w+`|\bON\s+DUPLICATE\s+KEY\b"}
# First match wins, by plain text.
QUICK = (
    ("T-SQL", ("DECLARE @", "SET @", "EXEC ", "EXECUTE ", "@@")), ("PL/SQL", ("DECLARE", "BEGIN", "END;", "EXCEPTION", "CURSOR")), ("PostgreSQL", ("$1", "$2", "RETURNING", "::")),
    ("Oracle", ("DUAL", "ROWNUM", "CONNECT BY")), ("MySQL", ("LIMIT", "`", "IFNULL")),
)
# One spelling for functions of several dialects.
FUNCTIONS = (("ISNULL", "COALESCE"), ("NVL", "COALESCE"), ("IFNULL", "COALESCE"), ("GETDATE", "CURRENT_TIMESTAMP"), ("NOW", "CURRENT_TIMESTAMP"), ("DATEDIFF", "DATE_DIFF"), ("DATEADD", "DATE_ADD"), ("LEN", "LENGTH"))


def scores(sql: Column) -> dict[str, Column]:
    """Sum of the weights of the signs that match, for each dialect."""
    u = F.upper(sql)
    return {d: sum((F.when(u.rlike(p), w).otherwise(0) for w, p, _ in signs), F.lit(0)) for d, signs in SIGNS.items()}


def signs(sql: Column) -> Column:
    """Names of the signs that match, in order."""
    u = F.upper(sql)
    return F.array_compact(F.array(*(F.when(u.rlike(p), f"{d} {name}") for d, rows in SIGNS.items() for _, p, name in rows)))


def detected(df: DataFrame, sql: str = "sql_text") -> DataFrame:
    """df with dialect, that of the highest score, the first on a tie, and confidence, its share of all scores, times 1.2 on a strong sign.

    Without any sign: ANSI SQL with confidence 0. Each distinct text is looked at once.
    """
    once = df.select(F.col(sql).alias("text")).distinct().withColumn("u", F.upper("text"))
    once = once.select("text", "u", F.array(*scores(F.col("u")).values()).alias("s"))
    best, total = F.array_max("s"), F.aggregate("s", F.lit(0), lambda a, x: a + x)
    name = F.when(best == 0, "ANSI SQL").otherwise(F.get(F.array(*map(F.lit, SIGNS)), F.array_position("s", best).cast("int") - 1))
    once = once.select("text", "u", name.alias("dialect"), F.coalesce(best / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("share"))
    strong = F.lit(False)
    for d, p in STRONG.items():
        strong = strong | ((F.col("dialect") == d) & F.col("u").rlike(p))
    once = once.select("text", "dialect", F.round(F.least(F.lit(1.0), F.col("share") * F.when(strong, 1.2).otherwise(1.0)), 6).alias("confidence"))
    return df.join(once, F.col(sql).eqNullSafe(F.col("text"))).drop("text")


def quick(sql: Column) -> Column:
    u, out = F.upper(sql), F.when(F.lit(False), "")
    for d, words in QUICK:
        out = out.when(sum((u.contains(w).cast("int") for w in words), F.lit(0)) > 0, d)
    return out.otherwise("Standard SQL")


def normalize(sql: Column) -> Column:
    """A spelling for comparison, never to be run: quotes, function names and TOP in one form."""
    out = F.regexp_replace(F.regexp_replace(sql, r"\[([^\]]+)\]", '"$1"'), r"`([^`]+)`", '"$1"')
    for a, b in FUNCTIONS:
        out = F.regexp_replace(out, rf"(?i)\b{a}\s*\(", f"{b}(")
    return F.regexp_replace(out, r"(?i)\bTOP\s+(\d+)\b", "LIMIT $1")


def notes(sql: Column) -> Column:
    """What normalize changes."""
    each = [F.when(sql.rlike(r"\[[^\]]+\]"), "brackets"), F.when(sql.rlike("`[^`]+`"), "backticks"), *(F.when(sql.rlike(rf"(?i)\b{a}\s*\("), f"{a} to {b}") for a, b in FUNCTIONS), F.when(sql.rlike(r"(?i)\bTOP\s+\d+\b"), "TOP to LIMIT")]
    return F.array_compact(F.array(*each))
