"""Deadlines that fire with the clock: a stateful stage that keeps a deadline for each open run.

A run whose last event left it open expires when no newer event has come by
that event's time plus the limit of its status.  The stage keeps a run's recent
events and, with them, the earliest deadline that no known event has met; a
newer event moves it, a terminal event clears it, and a run that is decided
leaves the state store.  With event time, a deadline fires once the watermark
has passed it, so rows out of order within the delay are still counted; with
processing time it fires by the cluster's clock.

Runs are dealt by their hash into buckets, the keys of the stage.  A bucket's
events are one table in the state store, settled for all its runs at once, and
its timer stands at the earliest deadline of its runs: a call to Python and to
the store costs milliseconds, which each run would pay in each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 2048
EVENTS = pa.schema({"run": pa.string(), "at": pa.int64(), "seq": pa.int64(), "status": pa.string(), "decided": pa.bool_()})


def _fresh(part: pd.DataFrame) -> pa.Table:
    run, seq, status = (pa.array(part[c], pa.string(), from_pandas=True) for c in ("run", "seq", "status"))
    at = pa.array(part["at"], pa.int64(), from_pandas=True)
    return pa.Table.from_arrays([run, at, seq.cast("int64"), status, pa.repeat(False, len(part))], schema=EVENTS)


def _pack(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, EVENTS) as out:
        out.write_table(events)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(packed)).read_all()


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Deadlines(StatefulProcessor):
    def __init__(self, limits: dict[str, int], clock: str):
        self.limits, self.clock = limits, clock  # milliseconds by open status
        self.longest = max(limits.values())

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "events binary, timer bigint")

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.clock == "eventTime" else times.getCurrentProcessingTimeInMs()

    def _settle(self, events: pa.Table, now: int) -> tuple[pa.Table, pa.Table, int | None]:
        """Expired events with their deadlines, the events that still matter and the time of the bucket's timer."""
        events = events.group_by(EVENTS.names, use_threads=False).aggregate([])
        events = events.take(pc.sort_indices(events, sort_keys=[(c, "ascending") for c in EVENTS.names]))
        (run, runs), (status, names) = _coded(events["run"]), _coded(events["status"])
        at = events["at"].combine_chunks().to_numpy()
        decided = events["decided"].to_numpy()
        open_ = np.array([x in self.limits for x in names], bool)[status]
        until = at + np.array([self.limits.get(x, 0) for x in names], "int64")[status]
        last = np.append(run[1:] != run[:-1], True)
        unmet = open_ & ~decided & (last | (np.append(at[1:], 0) > until))
        fired, waits = unmet & (until <= now), unmet & (until > now)
        kept = at + self.longest > now
        waiting = np.zeros(len(runs), bool)
        waiting[run[waits]] = True
        idle = last & kept & ~waiting[run]
        due = np.concatenate([until[waits], at[idle] + self.longest])
        expired = events.filter(pa.array(fired)).drop_columns("decided").append_column("deadline", pa.array(until[fired]))
        events = events.set_column(4, "decided", pa.array(decided | fired)).filter(pa.array(kept))
        return expired, events, int(due.min()) if len(due) else None

    def _step(self, fresh: list[pa.Table], times, rung: int | None = None) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        packed, timer = held or (None, None)
        parts = [_unpack(packed), *fresh] if held else fresh
        if not parts:
            return
        expired, kept, due = self._settle(pa.concat_tables(parts), self._now(times))
        # Spark itself deletes the timer that rang
        if timer is not None and timer not in (due, rung):
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if due is not None:
            self.held.update((_pack(kept), due))
        elif held:
            self.held.clear()
        if len(expired):
            yield expired.to_pandas()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step([_fresh(part) for part in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _cast(kind: str) -> Callable[[Column], Column]:
    return lambda column: column.cast(kind)


def deadline_timers(events: DataFrame, run: str, ts: str, status: str, seq: str, limits: dict[str, str], watermark: str = "0 seconds",
                    clock: str = "eventTime", buckets: int = BUCKETS) -> DataFrame:
    """(run, seq, status, updated_at, expired_at) of every open event that no newer one follows within its status' limit.

    ``limits`` gives an interval for each open status.  Times count in milliseconds.  The session's state store must
    be RocksDB (``STATE_STORE``).  A task holds one bucket's recent events at a time; ``buckets`` stays as it is for the
    life of a checkpoint.
    """
    if clock not in ("eventTime", "processingTime"):
        raise ValueError("clock must be 'eventTime' or 'processingTime'")
    ms = {s: int(pd.Timedelta(x).total_seconds() * 1000) for s, x in limits.items()}
    rows = events.withWatermark(ts, watermark) if clock == "eventTime" else events
    run_type = events.schema[run].dataType.simpleString()
    # run and seq as text: whole numbers beside a missing one would become floats in a frame
    name, back = (F.hex, F.unhex) if run_type == "binary" else (_cast("string"), _cast(run_type))
    rows = rows.select(F.pmod(F.xxhash64(F.col(run)), F.lit(buckets)).alias("bucket"), name(F.col(run)).alias("run"), F.col(ts).alias("time"),
                       F.unix_millis(F.col(ts)).alias("at"), F.col(seq).cast("string").alias("seq"), F.col(status).alias("status"))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        Deadlines(ms, clock), "run string, at bigint, seq bigint, status string, deadline bigint", "Append", clock)
    return out.select(back(F.col("run")).alias(run), F.col("seq").alias(seq), F.col("status").alias(status),
                      F.timestamp_millis("at").alias("updated_at"), F.timestamp_millis("deadline").alias("expired_at"))
