"""Data-quality diagnostics and input guards.

Nothing here deletes rows: suspects and duplicates are reported so a plan can
handle them explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.dataset import Dataset
from planwise.functions.exprs import compact_key, quote_id, sql_literal

# Labels that often mark summary rows inside data (they must
# equal the reference's list).
SUMMARY_LABELS = ("all", "total", "subtotal", "grand total", "合计", "总计", "小计", "全部")


class GuardError(ValueError):
    """Input that a chart or plan must reject (never silently repaired)."""


# Unicode-aware trim (ideographic spaces included).
TRIM_PATTERN = r"(?U)^\s+|\s+$"


def _normalised(col):
    # Trimmed, then lower case.
    return F.lower(F.regexp_replace(col, TRIM_PATTERN, ""))


def summary_suspects(ds: Dataset) -> DataFrame:
    """(field, value, rows) for string cells that look like summary labels."""
    ids = [f.id for f in ds.fields if f.dtype == "string"]
    if not ids:
        spark = ds.df.sparkSession
        return spark.createDataFrame([], "field string, value string, rows bigint")
    long = ds.df.select(*ids).unpivot([], ids, "field", "raw")
    norm = long.select("field", _normalised(F.col("raw")).alias("value"))
    return (norm.filter(F.col("value").isin(list(SUMMARY_LABELS)))
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows")))


def review_counts(ds: Dataset) -> DataFrame:
    """Rows, exact duplicate rows and suspect label cells in ONE aggregate.

    Grouping by every column collapses identical rows map-side; each distinct
    row then carries its multiplicity, so rows = sum(count), duplicates =
    sum(count - 1) and suspect cells = sum(count * suspect cells in the row).
    One shuffle instead of three scans, with long texts as their SHA-256.
    """
    ids = [f.id for f in ds.fields if f.dtype == "string"]
    labels = ", ".join(sql_literal(x) for x in SUMMARY_LABELS)
    trim = sql_literal(TRIM_PATTERN)
    cells = " + ".join(f"coalesce(CAST(lower(regexp_replace({quote_id(c)}, {trim}, '')) IN ({labels}) AS INT), 0)"
                       for c in ids) or "0"
    keys = [f"{compact_key(c, ds.df.schema)} AS _k{i}" for i, c in enumerate(ds.df.columns)]
    grouped = (ds.df.selectExpr(*keys, f"{cells} AS _cells").groupBy(*[f"_k{i}" for i in range(len(keys))], "_cells")
               .agg(F.count(F.lit(1)).alias("_n")))
    return grouped.selectExpr(
        "CAST(coalesce(sum(_n), 0) AS BIGINT) AS rows",
        "CAST(coalesce(sum(_n - 1), 0) AS BIGINT) AS exact_duplicate_rows",
        f"CAST(coalesce(sum(_n * _cells), 0) AS BIGINT) AS suspect_rows")


def data_review(ds: Dataset) -> dict:
    """Rows, exact duplicate rows, suspect summary labels and carried warnings."""
    counts = review_counts(ds).first()
    suspects = []
    if counts["suspect_rows"]:
        suspects = [r.asDict() for r in summary_suspects(ds).orderBy("field", "value").collect()]
    return {
        "rows": counts["rows"],
        "exact_duplicate_rows": counts["exact_duplicate_rows"],
        "possible_summary_rows": suspects,
        "warnings": list(ds.warnings),
        "policy": "A label only hints at a summary row, and equal rows may be separate events: nothing is removed "
                  "unless a plan says so.",
    }


def review_frame(ds: Dataset) -> DataFrame:
    """The review as (metric, value) rows, from the single aggregate above."""
    return review_counts(ds).unpivot([], ["rows", "exact_duplicate_rows", "suspect_rows"], "metric", "value")


# ---- guards (G3-G6) ------------------------------------------------------
def _violations(df: DataFrame, condition) -> int:
    return df.filter(condition).limit(1).count()


def check_coordinates(df: DataFrame, lon: str, lat: str) -> None:
    """Every row must hold a WGS84 point; a null coordinate is invalid."""
    ok = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    if _violations(df, ~F.coalesce(ok, F.lit(False))):
        raise GuardError("a coordinate is missing or not on the globe (WGS84 degrees)")


def check_numeric_axis(df: DataFrame, column: str) -> None:
    """A non-null value on a value axis must be a number."""
    c = F.col(column)
    if _violations(df, c.isNotNull() & c.cast("string").try_cast("double").isNull()):
        raise GuardError(f"{column}: a value axis needs numbers")


def check_non_negative(df: DataFrame, column: str) -> None:
    if _violations(df, F.col(column) < 0):
        raise GuardError(f"{column}: flows and funnels cannot hold negative values")


def check_positive_finite(df: DataFrame, measure: str, denominator: str) -> None:
    m, d = F.col(measure), F.col(denominator)
    bad = (d <= 0) | F.isnan(m) | (F.abs(m) == float("inf")) | F.isnan(d) | (F.abs(d) == float("inf"))
    if _violations(df, bad):
        raise GuardError(f"{measure} / {denominator}: needs finite numbers and denominators above zero")
