"""Deadline timers and late rows over a folder that grows between runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from planwise.session import scratch_dir
from planwise.streaming import deliver, event_stream, run_available
from planwise.streaming.late import read_late, read_plan, run_plan_with_late
from planwise.streaming.timers import STATE_STORE, deadline_timers

SCHEMA = "seq long, run string, status string, ts timestamp_ntz, value double"
T0 = dt.datetime(2026, 1, 1)
LIMITS = {"queued": 60, "running": 150}


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.set(key, before)


def _drop(spark, folder, rows):
    spark.createDataFrame([(s, r, x, T0 + dt.timedelta(seconds=k), v) for s, r, x, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _expired(rows, now):
    out = []
    for run in {r[1] for r in rows}:
        mine = sorted((k, s, x) for s, r, x, k, _ in rows if r == run)
        for i, (k, s, x) in enumerate(mine):
            if x in LIMITS and k + LIMITS[x] <= now and not (i + 1 < len(mine) and mine[i + 1][0] <= k + LIMITS[x]):
                out.append((run, s, x, k, k + LIMITS[x]))
    return sorted(out)


def test_deadlines_fire_once_in_any_order_of_arrival(spark, tmp_dir, rocksdb):
    rng = random.Random(6)
    source, out = f"{tmp_dir}/in", scratch_dir(spark, "timers")
    schema = spark.createDataFrame([], SCHEMA).schema
    rows, clock = [], 0
    for part in range(4):
        fresh = [(100 * part + n, f"r{rng.randrange(12)}", rng.choice(["queued", "running", "done"]), clock + rng.randrange(400), 1.0)
                 for n in range(40)]
        # rows out of order, but inside the delay of 400 seconds
        rows += fresh
        clock += 300
        _drop(spark, source, fresh)
        stream = event_stream(spark, source, schema, time_col="ts")
        fired = deadline_timers(stream, "run", "ts", "status", "seq", {"queued": "60s", "running": "150s"}, "400 seconds")
        data = run_available(fired, out)
        got = spark.read.parquet(data).select("run", "seq", "status", (F.unix_seconds("updated_at")).alias("a"), F.unix_seconds("expired_at").alias("b"))
        base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
        assert sorted((r.run, r.seq, r.status, r.a - base, r.b - base) for r in got.collect()) == _expired(rows, max(r[3] for r in rows) - 400)


def test_many_runs_share_a_bucket_and_its_timer(spark, tmp_dir, rocksdb):
    rng = random.Random(7)
    names = [None, *[2**60 + n for n in range(300)]]
    rows = [(n, rng.choice(names), rng.choice(["queued", "running", "done"]), rng.randrange(3000), 1.0) for n in range(2000)]
    rows.append((2000, names[1], "done", 9000, 1.0))
    schema = SCHEMA.replace("run string", "run long")
    source = f"{tmp_dir}/in"
    spark.createDataFrame([(s, r, x, T0 + dt.timedelta(seconds=k), v) for s, r, x, k, v in rows], schema).coalesce(1).write.parquet(source)
    stream = event_stream(spark, source, spark.read.parquet(source).schema, time_col="ts")
    fired = deadline_timers(stream, "run", "ts", "status", "seq", {"queued": "60s", "running": "150s"}, buckets=4)
    query = fired.writeStream.format("memory").queryName("shared_timers").trigger(availableNow=True).start()
    query.awaitTermination()
    stores = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert stores[0]["customMetrics"]["numRegisteredTimers"] <= 4 and stores[0]["numRowsTotal"] <= 4
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = spark.table("shared_timers").select("run", "seq", "status", F.unix_seconds("updated_at").alias("a"), F.unix_seconds("expired_at").alias("b"))
    named = [(-1 if r is None else r, s, x, a, b) for r, s, x, a, b in _expired_by(rows, 9000)]
    assert sorted((-1 if r.run is None else r.run, r.seq, r.status, r.a - base, r.b - base) for r in got.collect()) == sorted(named)


def _expired_by(rows, now):
    return [e for run in {r[1] for r in rows} for e in _expired([r for r in rows if r[1] == run], now)]


def test_parts_of_any_size_are_micro_batches_of_their_own(spark, tmp_dir):
    source, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    sizes = (1000, 0, 1, 500)
    for n in sizes:
        deliver(spark.range(n), source, 4)
    stream = event_stream(spark, source, spark.range(0).schema, max_files_per_trigger=4)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/data")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress] == list(sizes)
    assert spark.read.parquet(f"{out}/data").count() == sum(sizes)


def test_late_rows_go_to_their_own_output(spark, tmp_dir):
    source, out = f"{tmp_dir}/in", scratch_dir(spark, "late")
    schema = spark.createDataFrame([], SCHEMA).schema
    day = 86_400
    parts = [[(1, "a", "x", 0, 2.0), (2, "a", "x", 3 * day, 3.0)], [(3, "a", "x", 10, 5.0), (4, "b", "x", 2 * day, 7.0), (5, "b", "x", 4 * day, 1.0)], []]
    for part in parts:
        if part:
            _drop(spark, source, part)
        run_plan_with_late(event_stream(spark, source, schema), out, "ts", "day", ["run"], "mean", "value", watermark="1 day")
    got = {(r.ts, r.run): r.value for r in read_plan(spark, out, "ts", "day", ["run"], "mean").collect()}
    assert got == {("2026-01-01", "a"): 2.0, ("2026-01-04", "a"): 3.0, ("2026-01-03", "b"): 7.0, ("2026-01-05", "b"): 1.0}
    assert [r.seq for r in read_late(spark, out, schema).collect()] == [3]
    counts = {r.batch: (r.late, r.on_time) for r in spark.read.parquet(f"{out}/counts").collect()}
    assert counts == {0: (0, 2), 1: (1, 2)}
