"""Calendar buckets and their coverage (partial-period detection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.functions.exprs import bucket_end, bucket_start, time_bucket


def bucket_coverage(df: DataFrame, column: str, grain: str) -> DataFrame:
    """Rows per bucket and whether the bucket is only partly observed.

    A bucket is an edge bucket when it starts before the first observed day
    or ends after the last one.  Output: bucket, rows, is_edge.
    """
    c = F.col(column)
    per = df.filter(c.isNotNull()).groupBy(time_bucket(c, grain).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(c).alias("_first"), F.max(c).alias("_last"))
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    start = bucket_start(F.col("_first"), grain).cast("date")
    end = F.date_sub(bucket_end(F.col("_first"), grain).cast("date"), 1)
    edge = (start < F.lit(lo).cast("date")) | (end > F.lit(hi).cast("date"))
    return per.select("bucket", "rows", edge.alias("is_edge"))
