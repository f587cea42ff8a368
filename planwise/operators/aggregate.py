"""The plan's aggregations as Spark aggregate expressions.

Every aggregation here is algebraic (sum/count/min/max/avg), so Spark runs a
partial aggregate before the shuffle: a group that holds a third of all rows
is reduced map-side to one row per task before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwise.functions.exprs import guard

ZERO_GROUP_DENOMINATOR = "a group's denominators add up to zero"
ZERO_ROW_DENOMINATOR = "a row has a zero denominator"


def value_expression(aggregation: str, metric: str | None, denominator: str | None,
                     checked: "callable[[Column], Column]" = lambda c: c,
                     column: "callable[[str], Column]" = F.col) -> Column:
    """Aggregate expression for ``value``; ``column`` reads a field.

    ``checked`` wraps the per-row input so row-level guards (missing values)
    run inside the aggregate the query needs anyway.
    """
    if aggregation == "count":
        return F.count(checked(F.lit(1)))
    m = checked(column(metric))
    if aggregation == "sum":
        return F.sum(m)
    if aggregation == "mean":
        return F.avg(m)
    if aggregation == "min":
        return F.min(m)
    if aggregation == "max":
        return F.max(m)
    d = column(denominator)
    if aggregation == "ratio_total":
        num, den = F.sum(m), F.sum(d)
        return guard(den == 0, ZERO_GROUP_DENOMINATOR, num / den)
    if aggregation == "ratio_mean":
        return F.avg(guard(d == 0, ZERO_ROW_DENOMINATOR, m / d))
    raise ValueError(f"no aggregate expression for {aggregation!r}")
