"""Streams over an append-only folder of files.

* ``tail_terminal`` - follow an event log and emit rows whose status is
  terminal (append mode; the checkpoint remembers what was read).
* ``deadline_sessions`` - per run, a session closes after ``gap`` without
  events; a closed session whose last status is still open is overdue.
  Works on batch and streaming frames (session windows + watermark).
* ``stream_plan`` - a plan's grouped aggregate on event-time buckets with a
  watermark; late rows beyond the watermark are dropped.

Sinks write each micro-batch under ``batch=<id>`` with overwrite, so a
replayed batch after a failure replaces its own output (idempotent), and
``read_latest`` resolves the newest version of each group.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planwise.functions.exprs import quote_id, time_bucket
from planwise.operators.aggregate import value_expression
from planwise.operators.runlog import OPEN_STATUSES

# Fixed Monday alignment: the epoch (1970-01-01) is a Thursday.
WEEK_START_OFFSET = "4 days"
STREAMABLE_AGGREGATIONS = ("sum", "mean", "count", "min", "max", "ratio_total")


def event_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                 time_col: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; a wall-clock-free ``timestamp_ntz`` event time is
    re-typed as ``timestamp`` (UTC session) so it can carry a watermark."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(directory)
    if time_col and isinstance(schema[time_col].dataType, T.TimestampNTZType):
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return df


def deliver(part: DataFrame, folder: str, files: int) -> None:
    """Append ``part`` to the folder as ``files`` Parquet files, with empty ones for what it has too few rows to fill: a
    stream that takes ``files`` files per trigger takes each part so delivered as one micro-batch."""
    spark = part.sparkSession

    def there() -> int:
        try:
            return len(spark.read.schema(part.schema).parquet(folder).inputFiles())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    wanted = there() + files
    part.repartition(files).write.mode("append").parquet(folder)
    for _ in range(wanted - there()):
        spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)


def tail_terminal(events: DataFrame, status: str, terminal: tuple[str, ...]) -> DataFrame:
    return events.filter(F.col(status).isin(list(terminal)))


def deadline_sessions(events: DataFrame, run: str, ts: str, status: str, seq: str, gap: str,
                      watermark: str | None = None, open_statuses: tuple[str, ...] = OPEN_STATUSES) -> DataFrame:
    """One row per (run, activity session): start, end (= last event + gap),
    events, last status and whether the run was left open past its deadline.
    ``build_session`` merges sessions inside each task before the shuffle."""
    df = events.withWatermark(ts, watermark) if watermark else events
    sessions = df.groupBy(run, F.session_window(ts, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("events"), F.max_by(F.col(status), F.col(seq)).alias("last_status"))
    return sessions.select(run, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                           "events", "last_status", F.col("last_status").isin(list(open_statuses)).alias("overdue"))


# Months and years have no fixed length, but event-time windows do.  A row's
# time is moved to a calendar whose months (years) all have the length of the
# shortest one: the days beyond it wait on its last instant.  That calendar
# never runs ahead of the real one inside a bucket, so a bucket stays open
# until its real end plus the delay has passed.
_DAY = 86_400_000_000
_EVEN = {"month": (28, "(year({t}) - 1970) * 12 + month({t}) - 1"), "year": (365, "year({t}) - 1970")}


def _even_time(ts: str, grain: str):
    days, index = _EVEN[grain]
    t = quote_id(ts)
    inside = f"unix_micros(CAST({t} AS TIMESTAMP)) - unix_micros(date_trunc('{grain}', CAST({t} AS TIMESTAMP)))"
    return F.expr(f"timestamp_micros(({index.format(t=t)}) * {days * _DAY}L + least({inside}, {days * _DAY - 1}L))")


def _from_even(start, grain: str):
    days, _ = _EVEN[grain]
    n = F.floor(F.unix_micros(start) / F.lit(days * _DAY)).cast("int")
    months = n if grain == "month" else n * 12
    return F.add_months(F.lit("1970-01-01").cast("date"), months).cast("timestamp")


def stream_plan(events: DataFrame, ts: str, grain: str, keys: list[str], aggregation: str,
                metric: str | None = None, denominator: str | None = None, watermark: str = "1 day",
                null_time: str = "error") -> DataFrame:
    """A plan's aggregate on a stream, bucketed by event time.

    The watermark follows the events' own time: a bucket takes rows until its
    end plus ``watermark`` has passed, then leaves the state store, and later
    rows for it are late and dropped.  A row without an event time stops the
    query (``null_time="error"``) or is left out (``"drop"``).
    """
    if aggregation not in STREAMABLE_AGGREGATIONS:
        raise ValueError(f"aggregation {aggregation!r} cannot run incrementally")
    if null_time not in ("error", "drop"):
        raise ValueError("null_time must be 'error' or 'drop'")
    value = value_expression(aggregation, metric, denominator).alias("value")
    if null_time == "error":
        events = events.withColumn(ts, F.coalesce(F.col(ts), F.raise_error(F.lit(f"a row has no {ts}"))))
    if grain in ("day", "week"):
        df = events.withWatermark(ts, watermark)
        win = F.window(ts, "1 day") if grain == "day" else F.window(ts, "7 days", "7 days", WEEK_START_OFFSET)
        out = df.groupBy(win.alias("w"), *keys).agg(value)
        return out.select(time_bucket(F.col("w.start"), grain).alias(ts), *keys, "value")
    df = events.withColumn("_even", _even_time(ts, grain)).withWatermark("_even", watermark)
    out = df.groupBy(F.window("_even", f"{_EVEN[grain][0]} days").alias("w"), *keys).agg(value)
    return out.select(time_bucket(_from_even(F.col("w.start"), grain), grain).alias(ts), *keys, "value")


def run_available(stream: DataFrame, out_dir: str, mode: str = "append") -> str:
    """Process everything available now, writing each micro-batch
    idempotently under ``out_dir/data/batch=<id>``; returns the data path."""
    data = f"{out_dir.rstrip('/')}/data"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{data}/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", f"{out_dir.rstrip('/')}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return data


def read_latest(spark: SparkSession, data: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """Newest emitted version of every group of an update-mode stream."""
    try:
        df = spark.read.parquet(data)
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)  # nothing emitted yet
    cols = [c for c in df.columns if c not in keys and c != "batch"]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("batch"))
    return df.groupBy(*keys).agg(best.alias("_s")).select(*keys, "_s.*")
