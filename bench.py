"""Benchmark: headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR.

Prints ONE JSON line.  Each query runs once cold, then BENCH_REPEATS warm
times; the reported value per query is the warm median in seconds.  Queries
execute fully through Spark's ``noop`` sink (no driver collection).  The
reference's own micro-benchmark (grouped sum of 20 text groups) is rebuilt
with ``spark.range`` at 1M and 10M rows, and once more at ``BENCH_SCALE_ROWS``
(default 100M, 0 skips it) as a throughput point reported under ``scale``:
it is not part of the summed ``value``, so that stays comparable between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from planwise import Dataset, Plan, compile_plan  # noqa: E402
from planwise.registry import QUERIES  # noqa: E402
from planwise.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))
SCALE_ROWS = int(os.environ.get("BENCH_SCALE_ROWS", str(100_000_000)))

HEADLINE = [
    "plan_monthly_revenue",
    "agg_sum",
    "agg_ratio_mean",
    "missing_exclude",
    "dedupe_exact",
    "grain_week",
    "flt_conjunction",
    "top_evidence",
    "profile_orders",
    "review_summary",
    "sql_join_inner",
    "sql_pricing_summary",
    "sql_window_running",
    "mark_histogram",
    "mark_box",
    "mark_density",
    "log_latest",
    "log_recent30",
]


def synthetic(spark, n: int):
    """Reference workload: f1 = integer 0..19 as text, f2 = uniform(1,100), f3, f4 normal."""
    df = spark.range(n).select(
        (F.floor(F.rand(20260927) * 20)).cast("int").cast("string").alias("f1"),
        (F.rand(20260928) * 99 + 1).alias("f2"),
        F.randn(20260929).alias("f3"),
        F.randn(20260930).alias("f4"),
    ).cache()
    df.count()
    return Dataset.from_frame(df)


def timed(build) -> tuple[float, list[float]]:
    def once():
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0
    cold = once()
    warm = [once() for _ in range(REPEATS)]
    return cold, warm


def main() -> None:
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=CPUS,
                          extra={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    queries, cold, rows_per_s = {}, {}, {}
    lineitem_rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    for name in HEADLINE:
        c, w = timed(lambda n=name: QUERIES[n](spark, SF_DIR))
        queries[name] = round(statistics.median(w), 4)
        cold[name] = round(c, 4)
    grouped = Plan(group_by=("f1",), metric="f2", sort="desc")
    for n in (1_000_000, 10_000_000):
        ds = synthetic(spark, n)
        c, w = timed(lambda d=ds: compile_plan(d, grouped).df)
        key = f"grouped_sum_{n // 1_000_000}m"
        queries[key] = round(statistics.median(w), 4)
        cold[key] = round(c, 4)
        rows_per_s[key] = round(n / statistics.median(w))
        ds.df.unpersist()
    scale = {}
    if SCALE_ROWS:
        ds = synthetic(spark, SCALE_ROWS)
        c, w = timed(lambda d=ds: compile_plan(d, grouped).df)
        scale = {"rows": SCALE_ROWS, "warm_median_sec": round(statistics.median(w), 4), "cold_sec": round(c, 4),
                 "rows_per_sec": round(SCALE_ROWS / statistics.median(w))}
        ds.df.unpersist()
    rows_per_s["agg_sum"] = round(lineitem_rows / queries["agg_sum"])
    total = round(sum(queries.values()), 4)
    print(json.dumps({
        "metric": "sum_of_warm_median_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": queries,
        "cold": cold,
        "rows_per_sec": rows_per_s,
        "scale": scale,
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "lineitem_rows": lineitem_rows,
        "cpus": CPUS,
        "repeats": REPEATS,
    }))


if __name__ == "__main__":
    main()
