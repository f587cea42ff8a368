"""Column-expression helpers.  All JVM-side built-ins: they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

# Fixed values shown to users (they must equal the reference's).
MISSING_CATEGORY = "(missing)"
ALL_GROUP_LABEL = "All / 全部"


def guard(condition: Column, message: str, value: Column) -> Column:
    """``value``, or fail the query when ``condition`` holds for a row.

    Placing the check inside the value the query returns keeps it from being
    pruned by the optimiser and costs no extra pass over the data.
    """
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def quote_id(name: str) -> str:
    """A column name as a SQL identifier (backticks doubled inside)."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(text: str) -> str:
    """Text as a Spark SQL string literal (backslash and quote escaped)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unused_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def any_missing(columns: list[str], schema: StructType) -> Column:
    """True when any of ``columns`` is null, or not a number in a floating-point
    column.  Built as one SQL expression: each Column-API call is a driver
    round trip, and plans ask for this often."""
    if not columns:
        return F.lit(False)
    test = lambda c: f"{quote_id(c)} IS NULL" + (f" OR isnan({quote_id(c)})" if is_float(schema, c) else "")
    return F.expr(" OR ".join(test(c) for c in columns))


def is_float(schema: StructType, column: str) -> bool:
    return isinstance(schema[column].dataType, (DoubleType, FloatType))


SHORT_TEXT = 64


def compact_key(column: str, schema: StructType) -> str:
    """SQL text of a grouping key that stands for the column's value: long texts
    as their SHA-256 (marked, so that no short text equals one), so that they
    are not shuffled whole."""
    c = quote_id(column)
    if not isinstance(schema[column].dataType, StringType):
        return c
    return f"CASE WHEN length({c}) > {SHORT_TEXT} THEN concat('\\u0000', sha2(CAST({c} AS BINARY), 256)) ELSE {c} END"


def without_nan(column: str, schema: StructType) -> Column:
    """The column, with null for what is not a number."""
    c = F.col(column)
    return F.nanvl(c, F.lit(None).cast(schema[column].dataType)) if is_float(schema, column) else c


def week_label(col: Column) -> Column:
    """Monday-to-Sunday week as ``yyyy-MM-dd/yyyy-MM-dd``."""
    start = F.date_trunc("week", col).cast("date")
    return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))


def time_bucket(col: Column, grain: str) -> Column:
    """Label of the calendar bucket a timestamp falls in (null stays null)."""
    if grain == "day":
        return F.date_format(col, "yyyy-MM-dd")
    if grain == "week":
        return week_label(col)
    if grain == "month":
        return F.date_format(col, "yyyy-MM")
    if grain == "year":
        return F.date_format(col, "yyyy")
    raise ValueError(f"unknown time grain {grain!r}")


def bucket_start(col: Column, grain: str) -> Column:
    unit = {"day": "day", "week": "week", "month": "month", "year": "year"}[grain]
    return F.date_trunc(unit, col)


def bucket_end(col: Column, grain: str) -> Column:
    """Exclusive end of the bucket containing ``col``."""
    start = bucket_start(col, grain)
    if grain == "day":
        return start + F.expr("INTERVAL 1 DAY")
    if grain == "week":
        return start + F.expr("INTERVAL 7 DAYS")
    if grain == "month":
        return F.add_months(start.cast("date"), 1).cast("timestamp_ntz")
    return F.add_months(start.cast("date"), 12).cast("timestamp_ntz")


def format_value(col: Column, value_format: str = "number", decimals: int = 2) -> Column:
    """Display text of a value: grouped digits; ratios as percentages (x100)."""
    if value_format == "percent":
        return F.concat(F.format_number(col * 100, decimals), F.lit("%"))
    return F.format_number(col, decimals)


def missing_label(col: Column) -> Column:
    """Category text with nulls shown as a visible placeholder."""
    return F.coalesce(col.cast("string"), F.lit(MISSING_CATEGORY))


def sort_key(name: str, ascending: bool = True) -> Column:
    """Nulls last in both directions (pandas ``sort_values`` default)."""
    return F.asc_nulls_last(name) if ascending else F.desc_nulls_last(name)
