"""Deterministic synthetic tables built by Spark (no driver-side rows).

``sales(n)`` mirrors the shape of the reference's sample data: order id,
date, region, product, quantity and revenue; ``grouped_benchmark(n)`` is
the reference's micro-benchmark table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category labels of the sample tables.
REGIONS = ("East", "West", "South", "North")
PRODUCTS = ("A", "B", "C")


def sales(spark: SparkSession, n: int = 720, seed: int = 7) -> DataFrame:
    regions = F.array(*[F.lit(r) for r in REGIONS])
    products = F.array(*[F.lit(p) for p in PRODUCTS])
    return spark.range(n).select(
        F.format_string("O%05d", F.col("id") + 1).alias("order_id"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 167).cast("int")).cast("timestamp_ntz").alias("date"),
        regions[(F.xxhash64("id", F.lit(seed)) % 4 + 4) % 4].alias("region"),
        products[(F.xxhash64("id", F.lit(seed + 1)) % 3 + 3) % 3].alias("product"),
        (F.floor(F.rand(seed) * 9) + 1).alias("quantity"),
        F.round(F.rand(seed + 2) * 900 + 100, 2).alias("revenue"),
    )


def grouped_benchmark(spark: SparkSession, n: int, seed: int = 20260927) -> DataFrame:
    return spark.range(n).select(
        F.floor(F.rand(seed) * 20).cast("int").cast("string").alias("f1"),
        (F.rand(seed + 1) * 99 + 1).alias("f2"),
        F.randn(seed + 2).alias("f3"),
        F.randn(seed + 3).alias("f4"),
    )
