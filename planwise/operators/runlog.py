"""Run-log analytics over an append-only event table.

An event log has a run key, a sequence number, a status and an update time.
Latest state, overdue runs, superseded requests, recent-N lists and
compare-and-set publication are expressed as aggregates and joins whose hot
keys are reduced map-side or split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from planwise.operators.joins import join_stats
from planwise.session import ensure_checkpoint_dir

OPEN_STATUSES = ("queued", "running")
# Fixed deadlines in seconds (they must equal the reference's defaults):
# 60 s in the queue; the 120 s run timeout plus 30 s grace while running.
QUEUE_TIMEOUT_S = 60
RUNNING_TIMEOUT_S = 150


def latest_state(events: DataFrame, run: str, seq: str) -> DataFrame:
    """The event with the highest sequence number per run.

    ``max_by`` is a partial aggregate: each task keeps one candidate per run,
    so a run with billions of events costs one shuffle row per task.
    """
    others = [c for c in events.columns if c != run]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.col(seq))
    return events.groupBy(run).agg(best.alias("_s")).select(run, "_s.*")


def overdue_runs(latest: DataFrame, status: str, updated: str, as_of,
                 limits: dict[str, int] | None = None) -> DataFrame:
    """Open runs whose last update is older than their status's deadline.
    ``as_of`` is a timestamp value or a Column (e.g. a scalar subquery such
    as the log's latest event time)."""
    limits = limits or {"queued": QUEUE_TIMEOUT_S, "running": RUNNING_TIMEOUT_S}
    deadline = None
    for st, seconds in limits.items():
        cond = F.col(status) == st
        secs = F.lit(seconds)
        deadline = F.when(cond, secs) if deadline is None else deadline.when(cond, secs)
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp"))
    return (latest.withColumn("deadline_s", deadline)
            .filter(F.col("deadline_s").isNotNull() & (age > F.col("deadline_s") * F.lit(1_000_000)))
            .withColumn("age_s", age / F.lit(1_000_000)))


def superseded(events: DataFrame, key: str, seq: str, status: str | None = None,
               open_statuses: tuple[str, ...] = OPEN_STATUSES) -> DataFrame:
    """Flag every open request that has a newer one for the same key.

    With ``status`` only requests in ``open_statuses`` can go stale; without
    it every request counts as open.  A null key is a key.  The newest
    sequence number per key is aggregated first and joined back, so a hot key
    neither sorts nor meets in a single task.
    """
    newest = events.groupBy(key).agg(F.max(seq).alias("_newest"))
    still_open = F.col(status).isin(list(open_statuses)) if status else F.lit(True)
    return (join_stats(events, newest, [key])
            .withColumn("superseded", F.coalesce(still_open & (F.col(seq) < F.col("_newest")), F.lit(False)))
            .drop("_newest"))


def recent_per_key(events: DataFrame, key: str, order: str, k: int = 30) -> DataFrame:
    """The ``k`` newest rows per key (exact), with their 1-based rank.

    Stage 1 ranks within (key, input partition): each slice is bounded by
    one input split, so a hot key is spread over all tasks.  Stage 2 ranks
    the survivors, at most ``k`` per input partition.
    """
    sliced = events.withColumn("_slice", F.spark_partition_id())
    w1 = Window.partitionBy(key, "_slice").orderBy(F.col(order).desc())
    stage1 = sliced.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_slice")
    w2 = Window.partitionBy(key).orderBy(F.col(order).desc())
    return stage1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def recent(events: DataFrame, order: str, k: int = 30) -> DataFrame:
    """The ``k`` newest rows overall (top-k per task, then one small merge)."""
    return events.orderBy(F.col(order).desc()).limit(k)


def history_depth(revisions: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Root and depth of every revision reachable from a root (null parent).

    Pointer doubling: each round moves every revision from its known
    ancestor to that ancestor's known ancestor, so a chain of length L takes
    about log2(L) rounds (a recursive CTE takes L, and stops at its recursion
    limit).  A round is one join whose right side has one row per revision;
    a popular ancestor on the left is split by AQE's skew join.  Lineage is
    cut by a reliable checkpoint each round, and revisions that have reached
    their root only serve as targets.  A revision under a dangling parent or
    on a cycle has a null root and depth and the status ``unrooted``.
    Output: id, root, depth, status.
    """
    spark = revisions.sparkSession
    ensure_checkpoint_dir(spark)
    nodes = revisions.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    is_root = F.col("parent").isNull()
    # (id, anc, dist): ``anc`` is the ancestor ``dist`` steps up; a root points at itself.
    state = nodes.select("id", F.coalesce("parent", "id").alias("anc"),
                         F.when(is_root, 0).otherwise(1).alias("dist")).checkpoint(eager=True)
    rounds = max(state.count(), 2).bit_length() + 1  # enough to climb any acyclic chain
    for _ in range(rounds):
        hop = state.select(F.col("id").alias("_to"), F.col("anc").alias("_anc2"), F.col("dist").alias("_d2"))
        climbed = (state.where("dist > 0").join(hop, F.col("anc") == F.col("_to"), "left")
                   .select("id", F.coalesce("_anc2", "anc").alias("anc"),
                           (F.col("dist") + F.coalesce("_d2", F.lit(0))).alias("dist"),
                           (F.coalesce("_d2", F.lit(0)) > 0).alias("_moved")))
        moved = Observation()
        state = (climbed.observe(moved, F.count_if("_moved").alias("moved")).drop("_moved")
                 .unionByName(state.where("dist = 0")).checkpoint(eager=True))
        if moved.get["moved"] == 0:
            break
    roots = nodes.filter(is_root).select(F.col("id").alias("_root")).distinct()
    rooted = F.col("_root").isNotNull()
    return (state.join(roots, F.col("anc") == F.col("_root"), "left")
            .select(F.col("id").alias(id_col), F.col("_root").alias("root"), F.when(rooted, F.col("dist")).alias("depth"),
                    F.when(rooted, F.lit("rooted")).otherwise(F.lit("unrooted")).alias("status")))


def compare_and_set(results: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Accept a result only if every key still matches the current state
    (null-safe); everything else is stale.  Adds ``accepted``."""
    marked = state.select(*[F.col(k) for k in keys]).distinct().withColumn("_current", F.lit(True))
    cond = None
    for k in keys:
        c = F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
        cond = c if cond is None else cond & c
    joined = results.alias("r").join(marked.alias("s"), cond, "left")
    return joined.select("r.*", F.coalesce(F.col("s._current"), F.lit(False)).alias("accepted"))
