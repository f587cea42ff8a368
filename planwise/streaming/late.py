"""A plan on a stream that keeps the rows beyond the watermark.

Each micro-batch is parted by the watermark of the batches before it: rows
whose bucket has not ended, which are aggregated, and late rows, which go to an
output of their own and are counted.  Partial aggregates of a batch are merged
on reading.  All outputs of a batch, the watermark's state among them, lie under
``batch=<id>`` and depend on the batch and the state before it alone, so a
batch replayed after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.functions.exprs import quote_id, time_bucket

# (partial aggregates by name, value from the merged partials)
PARTS = {
    "sum": ({"s": "sum({m})"}, "s"),
    "mean": ({"s": "sum({m})", "n": "count({m})"}, "s / n"),
    "count": ({"n": "count(1)"}, "n"),
    "min": ({"lo": "min({m})"}, "lo"),
    "max": ({"hi": "max({m})"}, "hi"),
    "ratio_total": ({"s": "sum({m})", "d": "sum({d})"}, "s / d"),
}
MERGE = {"s": "sum", "n": "sum", "d": "sum", "lo": "min", "hi": "max"}


def bucket_end(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts) + F.expr(f"INTERVAL 1 {grain.upper()}")


def run_plan_with_late(stream: DataFrame, out_dir: str, ts: str, grain: str, keys: list[str], aggregation: str,
                       metric: str | None = None, denominator: str | None = None, watermark: str = "1 day") -> str:
    """Process what is available; returns ``out_dir`` with ``main``, ``late``, ``counts`` and ``state`` below it."""
    if aggregation not in PARTS:
        raise ValueError(f"aggregation {aggregation!r} cannot be merged from batches")
    out_dir = out_dir.rstrip("/")
    names = {"m": quote_id(metric) if metric else "1", "d": quote_id(denominator) if denominator else "1"}
    parts = [F.expr(x.format(**names)).alias(f"_{p}") for p, x in PARTS[aggregation][0].items()]

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.parquet(f"{out_dir}/state/batch={batch_id - 1}").first()[0] if batch_id else None
        at = F.col(ts).cast("timestamp")
        passed = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        is_late = F.coalesce(bucket_end(at, grain) <= passed, F.lit(False))
        batch = batch.withColumn("_late", is_late)
        batch.where("_late").drop("_late").write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")
        (batch.where("NOT _late").groupBy(F.date_trunc(grain, at).alias("_start"), *keys).agg(*parts)
         .write.mode("overwrite").parquet(f"{out_dir}/main/batch={batch_id}"))
        batch.agg(F.count_if("_late").alias("late"), F.count_if(~F.col("_late")).alias("on_time")).write.mode("overwrite").parquet(
            f"{out_dir}/counts/batch={batch_id}")
        (batch.agg(F.greatest(F.max(at), F.lit(seen).cast("timestamp")).alias("seen"))
         .write.mode("overwrite").parquet(f"{out_dir}/state/batch={batch_id}"))

    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out_dir}/checkpoint")
     .trigger(availableNow=True).start()).awaitTermination()
    return out_dir


def read_plan(spark: SparkSession, out_dir: str, ts: str, grain: str, keys: list[str], aggregation: str) -> DataFrame:
    """The plan's result over all rows that came in time: the bucket's label, the keys and ``value``."""
    parts, value = PARTS[aggregation]
    merged = (spark.read.parquet(f"{out_dir}/main").groupBy("_start", *keys)
              .agg(*[F.expr(f"{MERGE[p]}(_{p})").alias(p) for p in parts]))
    return merged.select(time_bucket(F.col("_start"), grain).alias(ts), *keys, F.expr(value).alias("value"))


def read_late(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    try:
        return spark.read.schema(schema).parquet(f"{out_dir}/late")
    except AnalysisException:
        return spark.createDataFrame([], schema)
