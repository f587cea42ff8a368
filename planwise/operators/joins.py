"""Joining per-group statistics back to rows without hot-key stragglers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.session import ensure_checkpoint_dir

# A side of at most this many rows of a few plain columns is broadcast.
BROADCAST_ROWS = 100_000
SALTS = 16


def join_stats(big: DataFrame, stats: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS,
               known_rows: int | None = None) -> DataFrame:
    """Join ``stats`` (one row per group) onto ``big``; a null key is a group.

    The statistics are materialised as a job of their own, so their size is
    known before the join is planned.  Up to ``broadcast_rows`` they are
    broadcast and ``big`` stays where it is.  Beyond that every statistics
    row is repeated once per salt and ``big`` is dealt by key and salt, so a
    key with a third of all rows is spread over ``SALTS`` tasks.  Statistics
    that are materialised already come with their number as ``known_rows``.
    """
    ensure_checkpoint_dir(big.sparkSession)
    stats = stats.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    if known_rows is None:
        stats = stats.checkpoint(eager=True)
        known_rows = stats.count()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    if known_rows <= broadcast_rows:
        out = big.join(F.broadcast(stats), same)
    else:
        salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int"))
        copies = stats.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(copies, same & (F.col("_salt") == F.col("_salt_of"))).drop("_salt", "_salt_of")
    return out.drop(*[f"_key_{k}" for k in keys])
