"""The eight filter predicates and brush selection (row-level, pushdown-friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwise.plans.plan import Filter


def _literal(value, dtype: str) -> Column:
    if dtype == "date":
        return F.lit(str(value)).cast("timestamp_ntz")
    return F.lit(value)


def predicate(flt: Filter, dtype: str) -> Column:
    """Column predicate for one filter.  A null never matches, except ``ne``
    on number and date fields, where null is "not equal" (NaN/NaT semantics
    of columnar storage).  Predicates stay plain comparisons (a null result
    drops the row) so the scan can push them down."""
    col = F.col(flt.field)
    op, value = flt.op, flt.value
    if op == "contains":
        return col.cast("string").contains(str(value))
    if op == "in":
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        return col.isin([_literal(v, dtype) for v in values])
    lit = _literal(value, dtype)
    if op == "eq":
        return col == lit
    if op == "ne":
        return ~col.eqNullSafe(lit) if dtype in ("number", "date") else col != lit
    if op in ("gt", "gte"):
        over = col > lit if op == "gt" else col >= lit
        # Spark orders NaN above every number; here it is missing.  The
        # comparison stays a conjunct of its own and reaches the scan.
        return over & ~F.isnan(col.cast("double")) if dtype == "number" else over
    if op == "lt":
        return col < lit
    if op == "lte":
        return col <= lit
    raise ValueError(op)  # pragma: no cover - Filter validates ops


def apply_filters(df: DataFrame, filters: Iterable[Filter], dtypes: dict[str, str]) -> DataFrame:
    """All filters ANDed, in order.  Chained ``filter`` calls are merged by
    Catalyst and pushed into the scan where the source supports it."""
    for flt in filters:
        df = df.filter(predicate(flt, dtypes[flt.field]))
    return df


def brush(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Rows inside an interval selection on both axes (inclusive bounds)."""
    return df.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))
