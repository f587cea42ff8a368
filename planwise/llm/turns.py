"""Turns of conversations in order, where one conversation may hold any share of the rows.

Order inside a conversation: turn (null first), role, then the text's digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwise.llm.common import portions, stored

PLACE = ["conv_id", "turn", "role", "digest"]


def digest(role: str = "role", text: str = "text") -> Column:
    """16 bytes that stand for a turn's role and text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def plain_turns(turns: DataFrame, null: str = "", conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text), a null role or text replaced; other columns are left behind."""
    return turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit(null)).alias("role"), F.coalesce(F.col(text), F.lit(null)).alias("text"))


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, bool, dict]]:
    """(key, whether it differs from the row before, row as a dict) of sorted rows, one by one."""
    held = object()
    for b in portions(batches):
        names = b.schema.names
        at = names.index(key)
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[at], row[at] != held, dict(zip(names, row))
            held = row[at]


def numbered(rows: DataFrame, key: str, order: list[str], name: str, then: Callable | None = None, added: str = "") -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their key in order (nulls first).

    Rows are range-partitioned by key and order, so a key with any share of the
    rows spreads over many tasks; each task numbers its own runs, and a run that
    goes on from earlier tasks adds their rows.  What is joined back is one
    number for each task of the sort.  ``then`` may map an iterator of a task's
    sorted batches to batches with the columns ``added`` behind: it runs once, after
    the sort's sampling and in the worker that numbers the rows.
    """
    by = [F.col(key), *[F.col(c) for c in order]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    names = dealt.columns

    def count(batches):
        held, run, at = object(), -1, 0
        for b in then(batches) if then else batches:
            if not b.num_rows:
                continue
            runs, places = [], []
            for k in b.column(names.index(key)).to_pylist():
                if k != held:
                    held, run, at = k, run + 1, 0
                runs.append(run)
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.int64()), pa.array(places, pa.int64())],
                                             [*b.schema.names, "_run", "_at"])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema], *([added] if added else [])])
    counted = stored(dealt.mapInArrow(count, f"{schema}, _run bigint, _at bigint"), name)
    ends = counted.groupBy("_part").agg(
        F.min(F.struct("_run", "_at", F.col(key).alias("k"))).alias("first"),
        F.max(F.struct("_run", "_at", F.col(key).alias("k"))).alias("last"),
        F.sum(F.when(F.col("_run") == 0, 1).otherwise(0)).alias("n"))
    runs = (ends.select("_part", F.col("first.k").alias("k"), "n", F.lit(True).alias("head"))
            .unionByName(ends.where("last._run > 0").select("_part", F.col("last.k").alias("k"),
                                                            (F.col("last._at") + 1).alias("n"), F.lit(False).alias("head"))))
    earlier = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (runs.withColumn("before", F.sum("n").over(earlier)).where("head AND before > 0")
              .select("_part", F.lit(0).cast("bigint").alias("_run"), "before"))
    return (counted.join(F.broadcast(before), ["_part", "_run"], "left")  # at most a row for each task of the sort
            .withColumn("pos", F.col("_at") + F.coalesce("before", F.lit(0))).drop("_part", "_run", "_at", "before"))


def per_row(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` maps an iterator of a task's sorted batches to tuples of ``schema``; tuples go out in bounded batches."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    names = [n for n, _ in fields]
    types = [_ARROW[t] for _, t in fields]

    def run(batches):
        held, size = [], 0
        for row in fn(batches):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if size >= 4 << 20 or len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
    return df.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(),
          "array<bigint>": pa.list_(pa.int64())}
