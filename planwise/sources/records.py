"""Records of delimited text, found in parallel where quoted cells hold line breaks.

Whether a line begins a record depends on all quotes before it in its file.
For each input split, one pass finds what the split does to that state: where
it leaves a reader that enters it between records, and one that enters it
inside quotes, and how many records begin in either case.  These functions are
composed along each file's splits, a table with one row for each split, which
gives every split its entering state and the number of its first record.  That
table is stored, so the first pass runs once, however often records are read.
A second pass over the splits emits the records; only those that cross a split
are put together by a shuffle.  Cells are then parsed by Spark.

Both passes look at the lines with quotes one by one; the lines between them
keep the state and are counted or taken as a run.

A record ends with a line feed, which a carriage return may precede.  A quote
opens a cell only as its first character; a doubled quote inside is a quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.session import ensure_checkpoint_dir

SPLIT = "_file string, _start bigint, out_of boolean, out_in boolean, n_of bigint, n_in bigint"
PIECE = "_split bigint, _row bigint, value binary, whole boolean"


def open_after(line: bytes, inside: bool, opening: bytes) -> bool:
    """Whether quotes are open after the line; ``opening`` is the delimiter and a quote."""
    at = 0
    if not inside:
        if not line.startswith(b'"'):
            at = line.find(opening)
            if at < 0:
                return False
            at += 1
        at += 1
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line.startswith(b'"', at + 1):
            at += 2
            continue
        at = line.find(opening, at + 1)
        if at < 0:
            return False
        at += 2


def _utf8(line: bytes, encoding: str) -> bytes:
    """The line in UTF-8; UTF-8 itself stays as it is, in other encodings U+FFFD marks what cannot be read."""
    return line if is_utf8(encoding) else line.decode(encoding, "replace").encode()


def is_utf8(encoding: str) -> bool:
    return encoding.lower().replace("-", "").replace("_", "") == "utf8"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return (spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")))


def _in_utf8(values: pa.Array, encoding: str) -> pa.Array:
    return values if is_utf8(encoding) else pa.array([_utf8(x, encoding) for x in values.to_pylist()], pa.binary())


def _runs(*keys: pa.Array) -> list[tuple[int, int]]:
    """(first, end) of the runs of rows with equal keys."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        at = k.dictionary_encode().indices.to_numpy()
        new |= at[1:] != at[:-1]
    cut = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(cut, cut[1:])) if n else []


def _quoted(values: pa.Array) -> np.ndarray:
    """Places of the lines with quotes; the others leave the state as it is."""
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def _splits(lines: DataFrame, opening: bytes, encoding: str) -> DataFrame:
    """For each split: the state it leaves and the records it begins, entered outside and inside quotes."""
    def scan(batches):
        held, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"_file": [held[0]], "_start": pa.array([held[1]], pa.int64()),
                                               "out_of": [state[0]], "out_in": [state[1]],
                                               "n_of": pa.array([state[2]], pa.int64()), "n_in": pa.array([state[3]], pa.int64())})

        def begun(n):
            state[2] += 0 if state[0] else n
            state[3] += 0 if state[1] else n
        for b in batches:
            values = _in_utf8(b.column(0), encoding)
            quoted = _quoted(values)
            for low, high in _runs(b.column(1), b.column(2)):
                split = (b.column(1)[low].as_py(), b.column(2)[low].as_py())
                if split != held:
                    if held:
                        yield done()
                    held, state = split, [False, True, 0, 0]
                at = low
                for q in quoted[np.searchsorted(quoted, low):np.searchsorted(quoted, high)].tolist():
                    begun(q + 1 - at)
                    line, same = values[q].as_py(), state[0] == state[1]
                    state[0] = open_after(line, state[0], opening)
                    state[1] = state[0] if same else open_after(line, state[1], opening)
                    at = q + 1
                begun(high - at)
        if held:
            yield done()
    return lines.mapInArrow(scan, SPLIT)


def _placed(splits: DataFrame) -> DataFrame:
    """(_file, _start, inside, before): the state in which each split is entered and the records begun before it."""
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("out_of") == F.col("out_in"), F.struct("out_of", "_turns"))
    turns = F.sum(F.when(F.col("out_of") & ~F.col("out_in"), 1).otherwise(0))
    upto = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    known = (splits.withColumn("_turns", turns.over(upto))
             .withColumn("_last", F.last(fixed, ignorenulls=True).over(earlier))
             .withColumn("_before", F.coalesce(F.lag("_turns").over(Window.partitionBy("_file").orderBy("_start")), F.lit(0))))
    odd = (F.col("_before") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1
    inside = F.coalesce("_last.out_of", F.lit(False)) != odd
    begun = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_of"))
    left = F.when(F.col("inside"), F.col("out_in")).otherwise(F.col("out_of"))
    return (known.withColumn("inside", inside).withColumn("before", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
            .select("_file", "_start", "inside", "before", left.alias("left_open"), (F.col("before") + begun).alias("upto")))


def _pieces(lines: DataFrame, opening: bytes, encoding: str) -> DataFrame:
    """Records, or what a split holds of them, with the record's number in its file."""
    def cut(batches) -> Iterator[pa.RecordBatch]:
        held = parts = None  # parts: lines of the open record
        inside = entered = False
        row, size = 0, 0
        rows, values, whole = [], [], []

        def flush():
            nonlocal rows, values, whole, size
            out = pa.RecordBatch.from_arrays(
                [pa.array([held] * len(rows), pa.int64()), pa.array(rows, pa.int64()), pa.array(values, pa.binary()),
                 pa.array(whole, pa.bool_())], [f.split()[0] for f in PIECE.split(", ")])
            rows, values, whole, size = [], [], [], 0
            return out

        def close(is_whole):
            nonlocal parts, size
            rows.append(row)
            values.append(b"\n".join(parts))
            whole.append(is_whole)
            size += len(values[-1]) + 64
            parts = None
        for b in batches:
            column = _in_utf8(b.column(0), encoding)
            lines, quoted = column.to_pylist(), _quoted(column)
            for low, high in _runs(b.column(1)):
                split = b.column(1)[low].as_py()
                if split != held:
                    if parts is not None:
                        close(False)
                    if rows:
                        yield flush()
                    held, inside, row = split, b.column(2)[low].as_py(), b.column(3)[low].as_py()
                    entered = inside
                    parts = [] if inside else None
                at = low
                for q in [*quoted[np.searchsorted(quoted, low):np.searchsorted(quoted, high)].tolist(), high]:
                    if inside:
                        parts += lines[at:q]
                    else:  # lines without quotes are records
                        for a in range(at, q, 8192):
                            plain = lines[a:min(a + 8192, q)]
                            rows += range(row + 1, row + 1 + len(plain))
                            values += plain
                            whole += [True] * len(plain)
                            row += len(plain)
                            size += sum(map(len, plain)) + 64 * len(plain)
                            if size >= 4 << 20 or len(rows) >= 8192:
                                yield flush()
                    if q == high:
                        break
                    if not inside:
                        parts, row, entered = [], row + 1, False
                    parts.append(lines[q])
                    inside = open_after(lines[q], inside, opening)
                    if not inside:
                        close(not entered)
                        if size >= 4 << 20 or len(rows) >= 8192:
                            yield flush()
                    at = q + 1
        if parts is not None:
            close(False)
        if rows:
            yield flush()
    return lines.mapInArrow(cut, PIECE)


def _records(lines: DataFrame, placed: DataFrame, opening: bytes, encoding: str) -> DataFrame:
    """(_file, _row, value) of the records in the splits ``placed``."""
    entered = lines.join(F.broadcast(placed), ["_file", "_start"]).select("value", "_split", "inside", "before")
    pieces = _pieces(entered, opening, encoding).withColumn("value", F.col("value").cast("string"))
    pieces = pieces.join(F.broadcast(placed.select("_split", "_file", "_start")), "_split")  # a path for each record, not for each line
    whole = pieces.where("whole").select("_file", "_row", "value")
    crossing = (pieces.where("NOT whole").groupBy("_file", "_row").agg(F.sort_array(F.collect_list(F.struct("_start", "value"))).alias("p"))
                .select("_file", "_row", F.array_join("p.value", "\n").alias("value")))
    return whole.unionByName(crossing).withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def read_records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """((_file, _row, value) of every record, (_file, _row) of a record whose quotes are open at its file's end).

    ``_row`` counts a file's records from 1.  The splits' states, one row for each input split, go to all tasks.
    """
    return read_with_row(spark, path, delimiter, encoding, 1)[:2]


def read_with_row(spark: SparkSession, path: str, delimiter: str, encoding: str, row: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``read_records`` gives, and the records numbered ``row``, for which only the splits that can hold them are cut."""
    lines, opening = _lines(spark, path, encoding), f'{delimiter}"'.encode()
    ensure_checkpoint_dir(spark)
    placed = _placed(_splits(lines, opening, encoding)).withColumn("_split", F.monotonically_increasing_id()).checkpoint()
    last = F.max_by(F.struct("left_open", "upto"), "_start").alias("end")
    unclosed = placed.groupBy("_file").agg(last).where("end.left_open").select("_file", F.col("end.upto").alias("_row"))
    records = _records(lines, placed, opening, encoding)
    near = placed.where((F.col("before") <= row) & (F.col("upto") >= row))
    return records, unclosed, _records(lines, near, opening, encoding).where(F.col("_row") == row)
