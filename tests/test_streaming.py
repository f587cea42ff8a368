"""Streams over a folder that grows between triggers."""

import datetime as dt
import os

from pyspark.sql import functions as F

from planwise.session import scratch_dir
from planwise.streaming import deadline_sessions, event_stream, read_latest, run_available, stream_plan, tail_terminal

SCHEMA = "seq long, run string, status string, ts timestamp_ntz, value double"


def _drop(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, name))


def test_deadline_sessions_close_after_watermark(spark, tmp_dir):
    src = os.path.join(tmp_dir, "log")
    t0 = dt.datetime(2026, 1, 1)
    _drop(spark, src, "b1", [(1, "r1", "queued", t0, 1.0), (2, "r2", "queued", t0, 1.0),
                             (3, "r2", "completed", t0 + dt.timedelta(seconds=30), 1.0)])
    schema = spark.createDataFrame([], SCHEMA).schema
    out = scratch_dir(spark, "deadline")

    def run():
        stream = event_stream(spark, src + "/*", schema, time_col="ts")
        sessions = deadline_sessions(stream, "run", "ts", "status", "seq", "150 seconds", watermark="10 seconds")
        return run_available(sessions, out, mode="append")

    run()
    # Nothing is closed until event time moves past session end + watermark.
    _drop(spark, src, "b2", [(4, "r3", "running", t0 + dt.timedelta(minutes=10), 1.0)])
    data = run()
    closed = {r["run"]: (r["last_status"], r["overdue"]) for r in spark.read.parquet(data).collect()}
    assert closed == {"r1": ("queued", True), "r2": ("completed", False)}


def test_tail_and_stream_plan_incremental(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ev")
    t0 = dt.datetime(2026, 1, 5)
    _drop(spark, src, "b1", [(1, "a", "completed", t0, 2.0), (2, "b", "running", t0, 3.0)])
    schema = spark.createDataFrame([], SCHEMA).schema
    out_tail, out_plan = scratch_dir(spark, "tail"), scratch_dir(spark, "plan")

    def run():
        stream = event_stream(spark, src + "/*", schema, time_col="ts")
        tail = run_available(tail_terminal(stream, "status", ("completed", "failed")).select("seq", "run"), out_tail)
        agg = stream_plan(stream, "ts", "day", ["status"], "sum", "value")
        plan = run_available(agg, out_plan, mode="update")
        return tail, plan

    run()
    _drop(spark, src, "b2", [(3, "c", "failed", t0 + dt.timedelta(hours=1), 4.0),
                             (4, "d", "completed", t0 + dt.timedelta(hours=2), 5.0)])
    tail, plan = run()
    assert sorted(r["seq"] for r in spark.read.parquet(tail).collect()) == [1, 3, 4]
    sums = {(r["ts"], r["status"]): r["value"] for r in read_latest(spark, plan, ["ts", "status"]).collect()}
    assert sums == {("2026-01-05", "completed"): 7.0, ("2026-01-05", "running"): 3.0, ("2026-01-05", "failed"): 4.0}


def test_month_buckets_finalise_after_watermark(spark, tmp_dir):
    """Month buckets carry the watermark on their start: in append mode a
    month is emitted (and leaves the state store) once a later month has
    moved the watermark past it; a row older than the watermark is dropped."""
    src = os.path.join(tmp_dir, "months")
    jan = dt.datetime(2026, 1, 10)
    _drop(spark, src, "b1", [(1, "a", "done", jan, 2.0), (2, "b", "done", jan + dt.timedelta(days=3), 3.0)])
    schema = spark.createDataFrame([], SCHEMA).schema
    out = scratch_dir(spark, "months")

    def run():
        stream = event_stream(spark, src + "/*", schema, time_col="ts")
        return run_available(stream_plan(stream, "ts", "month", ["status"], "sum", "value"), out, mode="append")

    run()
    _drop(spark, src, "b2", [(3, "c", "done", dt.datetime(2026, 3, 2), 5.0)])
    run()
    _drop(spark, src, "b3", [(4, "d", "done", dt.datetime(2026, 1, 20), 100.0),   # late: January is closed
                             (5, "e", "done", dt.datetime(2026, 3, 5), 1.0)])
    data = run()
    got = {(r["ts"], r["status"]): r["value"] for r in spark.read.parquet(data).collect()}
    assert got == {("2026-01", "done"): 5.0}
