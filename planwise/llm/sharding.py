"""Operator 10: shards by vector bin packing.

Every group of equal texts has a demand of three numbers: bytes, tokens and
rows.  A group goes to the shard whose residual capacity has the largest dot
product with the demand, both taken relative to the capacity of a shard and
weighted so that bytes decide first; larger groups first.  A group above a fixed part of a shard is cut by a hash
of its rows, so that no group makes a shard overflow.

Groups above 1/1000 of a shard (there can be at most 1000 for each shard and
measure) are placed first, together; the others are dealt to tasks that each
place their share into an equal part of the capacity the large ones left.

Defined cases: null text has no bytes and no tokens; null ids and repeated
rows are placed like others; an empty table gives an empty result.  The law is
`bytes`: the sizes (bytes plus 8 for each row) of the shards are near equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.common import stored, table

SHARDS = 24
MEASURES = ("size", "tokens", "rows")
WEIGHTS = np.array([1.0, 0.1, 0.003])  # in the dot product; the law is on bytes
PIECE = 4  # a group above this part of a shard is cut into pieces of about this part
LARGE = 1000  # what exceeds this part of a shard is placed first
TASK_PIECES = 20_000
BUCKET_ROWS = 50_000


def place(demand: np.ndarray, residual: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Shard of each demand, placed in the given order; ``residual`` (shards x measures) is used up."""
    scale = 1.0 / np.maximum(capacity, 1e-9)
    demand, left = demand * scale, residual * scale
    out = np.empty(len(demand), np.int32)
    for i, d in enumerate(demand):
        s = int(np.argmax(left @ (d * WEIGHTS)))
        out[i] = s
        left[s] -= d
    residual[:] = left / scale
    return out


def _descending(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Demands, and their order from the largest size."""
    demand = np.stack([rows[m].to_numpy().astype(float) for m in MEASURES], axis=1)
    return demand, np.lexsort((rows["piece"].to_numpy(), rows["h2"].to_numpy(), rows["h1"].to_numpy(), -demand[:, 0]))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """(doc id, size, tokens, text_crc32, shard, slot) for every row."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    digest = F.md5(raw)
    rows = stored(docs.select(
        F.col(doc_id).alias("_id"), (F.length(raw) + 8).cast("bigint").alias("size"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("h1"),
        F.conv(F.substring(digest, 16, 15), 16, 10).cast("bigint").alias("h2")), "shard-rows")
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("size", "tokens")],
                     F.count("*").alias("rows")).first()
    capacity = np.array([total[m] / shards for m in MEASURES], float)
    limit = [max(1.0, c / PIECE) for c in capacity]
    # at most shards * PIECE groups a measure exceed the limit: a bounded table
    cuts = F.greatest(*[F.ceil(F.col(m) / F.lit(x)) for m, x in zip(MEASURES, limit)])
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                                          F.count("*").alias("rows"))
    heavy = groups.where((F.col("rows") > 1) & (cuts > 1)).select("h1", "h2", cuts.alias("cuts"))
    # rows alike in all respects are told apart by the partition they were written to
    turn = F.xxhash64("_id", F.spark_partition_id(), F.monotonically_increasing_id())
    marked = stored(rows.withColumn("turn", turn).join(F.broadcast(heavy), ["h1", "h2"], "left")
                    .withColumn("piece", F.when(F.col("cuts").isNull(), F.lit(0))
                                .otherwise(F.pmod("turn", "cuts").cast("int"))).drop("cuts"), "shard-pieces")
    pieces = stored(marked.groupBy("h1", "h2", "piece").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shard-demands")
    large = F.greatest(*[F.col(m) * float(LARGE) / F.lit(max(c, 1e-9)) for m, c in zip(MEASURES, capacity)]) > 1
    n_small = pieces.where(~large).count()
    tasks = max(1, -(-n_small // TASK_PIECES))
    schema = "h1 bigint, h2 bigint, piece int, shard int, size bigint, tokens bigint, rows bigint"

    def placed(rows_, residual, share):
        demand, order = _descending(rows_)
        where = np.empty(len(order), np.int32)
        where[order] = place(demand[order], residual, share)
        return pa.table({"h1": rows_["h1"], "h2": rows_["h2"], "piece": rows_["piece"], "shard": pa.array(where),
                         **{m: rows_[m] for m in MEASURES}})

    def first(key: tuple[pa.Scalar, ...], rows_: pa.Table) -> pa.Table:
        return placed(rows_, np.tile(capacity, (shards, 1)), capacity)

    columns = ["h1", "h2", "piece", *MEASURES]
    ahead = stored(pieces.where(large).select(*columns, F.lit(0).alias("_task")).groupBy("_task")
                   .applyInArrow(first, schema), "shard-large")
    used = np.zeros((shards, len(MEASURES)))
    for r in ahead.groupBy("shard").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect():  # a row per shard
        used[r["shard"]] = [r[m] for m in MEASURES]
    residual = (capacity - used) / tasks

    def share(key: tuple[pa.Scalar, ...], rows_: pa.Table) -> pa.Table:
        free = residual.copy()
        # a task's own total decides; its capacity keeps the shape the large groups left
        for j, m in enumerate(MEASURES):
            free[:, j] += (float(np.sum(rows_[m].to_numpy())) - free[:, j].sum()) / shards
        shift = int(key[0].as_py()) % shards  # ties fall on another shard in each task
        where = placed(rows_, np.roll(free, -shift, axis=0), np.maximum(capacity / tasks, 1e-9))
        back = (where["shard"].to_numpy() + shift) % shards
        return where.set_column(3, "shard", pa.array(back.astype(np.int32)))

    small = (pieces.where(~large).select(*columns).withColumn("_task", F.pmod(F.xxhash64("h1", "h2", "piece"), F.lit(tasks)))
             .groupBy("_task").applyInArrow(share, schema))
    where = small.unionByName(ahead).select("h1", "h2", "piece", "shard")
    out = marked.join(where, ["h1", "h2", "piece"])
    # slots: buckets inside a shard are numbered on their own and set off by the buckets before them
    buckets = max(1, -(-int(total["rows"]) // (shards * BUCKET_ROWS)))
    out = stored(out.withColumn("_bucket", F.pmod(F.xxhash64("turn"), F.lit(buckets)).cast("int")), "shard-rows-placed")
    ahead_of = (out.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
                .withColumn("_before", F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("n")).drop("n"))
    slot = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "turn")) - 1
    return (out.withColumn("_in", slot).join(ahead_of, ["shard", "_bucket"])
            .select(F.col("_id").alias(doc_id), "size", "tokens", "text_crc32", "shard",
                    (F.col("_before") + F.col("_in")).cast("bigint").alias("slot")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (assign(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))
