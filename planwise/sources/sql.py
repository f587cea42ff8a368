"""Guarded read-only SQL over registered views, and SQL results as datasets.

The guard is Spark's own parser: the text is wrapped as a subquery, so only
a single query (SELECT / WITH / set operation / VALUES) can parse; INSERT,
DDL, SET, CACHE, scripting and statement chains fail.  Functions that reach
into the JVM are denied, and SQL on raw file paths is switched off.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from planwise.dataset import Dataset

# Fixed denylist: built-ins that call arbitrary JVM methods.
DENIED_FUNCTIONS = ("reflect", "java_method", "try_reflect")
SAFE_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
DEFAULT_ROW_LIMIT = 10_000


class SqlGuardError(ValueError):
    pass


# One scan from left to right: whichever of a quoted text or a comment starts
# first ends before anything else can start.
_SKIPPED = re.compile(
    r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*(?!\+).*?\*/""", re.S)
_DENIED_CLASSES = ("CallMethodViaReflection", "TryReflect")


def check_sql(sql: str) -> None:
    """Reject denied functions by the text (needed where Spark does not analyse it)."""
    code = _SKIPPED.sub(" '' ", sql)
    for fn in DENIED_FUNCTIONS:
        if re.search(rf"(?i)(?<![\w`]){fn}\s*\(", code) or re.search(rf"(?i)`{fn}`\s*\(", code):
            raise SqlGuardError(f"function {fn} is not allowed")


def check_analysed(df: DataFrame) -> None:
    """Reject denied functions by what Spark has resolved, however the text was quoted.

    Nothing has run yet: these functions are evaluated by rows only."""
    plan = df._jdf.queryExecution().analyzed()
    text = plan.toString() + plan.toJSON()
    for name in DENIED_FUNCTIONS:
        if re.search(rf"(?i)(?<![\w'.]){name}\(", text):
            raise SqlGuardError(f"function {name} is not allowed")
    for name in _DENIED_CLASSES:
        if f".{name}" in text:
            raise SqlGuardError("functions that call into the JVM are not allowed")


def guarded_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Run one read-only query; the whole result stays a lazy DataFrame."""
    check_sql(sql)
    body = sql.strip().rstrip(";") if sql.strip().endswith(";") and sql.count(";") == 1 else sql
    # Paths are resolved while the query is analysed, which happens inside
    # spark.sql(); the caller's setting is restored afterwards.
    previous = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        out = spark.sql(f"SELECT * FROM (\n{body}\n) AS guarded_query")
    except (ParseException, AnalysisException) as e:
        raise SqlGuardError(f"Not a single read-only query over known tables: {str(e).splitlines()[0]}") from e
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", previous)
    check_analysed(out)
    return out


def capped(df: DataFrame, limit: int = DEFAULT_ROW_LIMIT) -> DataFrame:
    """Reject (never truncate) a result with more than ``limit`` rows."""
    if int(limit) < 1:
        raise SqlGuardError("the row limit must be at least 1")
    if df.limit(int(limit) + 1).count() > limit:
        raise SqlGuardError(f"the result exceeds {limit} rows and is never cut: aggregate, or write a LIMIT into the query")
    return df


def sql_dataset(spark: SparkSession, sql: str, limit: int | None = DEFAULT_ROW_LIMIT) -> Dataset:
    """A guarded query result as a dataset with positional IDs and lineage."""
    df = guarded_sql(spark, sql)
    if limit is not None:
        df = capped(df, limit)
    ds = Dataset.from_frame(df, positional_ids=True, source="sql")
    return ds.with_frame(ds.df, {"operation": "query", "sql": sql})


def table_preview(spark: SparkSession, name: str, rows: int = 1000) -> DataFrame:
    if not SAFE_IDENTIFIER.match(name):
        raise SqlGuardError("unsafe table name")
    return spark.table(name).limit(rows)


def browse(spark: SparkSession) -> DataFrame:
    """(table, column, type) of every registered table and view."""
    rows = []
    for t in spark.catalog.listTables():
        for c in spark.catalog.listColumns(t.name):
            rows.append((t.name, c.name, c.dataType))
    return spark.createDataFrame(rows, "table string, column string, type string")
