"""Helpers shared by the operators of this subpackage.

A *block* is a run of rows of one input partition, closed once it holds
``block_bytes`` of text.  Blocks let a job talk to shuffled tables once per
distinct key and block instead of once per word of the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 12 << 20
PORTION_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder; Spark creates it on writing."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-shared-")  # one machine: driver and tasks share it
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


_written: list[list[str]] = []


@contextlib.contextmanager
def written_paths() -> Iterator[list[str]]:
    """Collects the paths that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written.pop()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    for paths in _written:
        paths.append(path)
    return spark.read.schema(schema).parquet(path)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete intermediates that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or it with underscores before it, so that no column clashes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of the texts; sizes the shards of a job."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def shard_count(total_bytes: int, shard_bytes: int = 8 << 20, least: int = 16) -> int:
    return max(least, -(-total_bytes // shard_bytes))


# ------------------------------------------------------------------ blocks
def _weight(batch: pa.RecordBatch) -> np.ndarray:
    out = np.full(batch.num_rows, 64, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            sizes = pc.fill_null(pc.binary_length(col), 0)
            out += sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def iter_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Cut a task's rows into (block id, rows); ids are unique over the job and repeat on a retry."""
    base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        start, ends = 0, np.cumsum(_weight(batch))
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + block_bytes - size)) + 1
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= block_bytes:
                yield base | k, pa.Table.from_batches(held)
                k, held, size = k + 1, [], 0
    if held:
        yield base | k, pa.Table.from_batches(held)


def portions(batches: Iterable[pa.RecordBatch], portion_bytes: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about ``portion_bytes`` of text at a time, so that what is made of them stays small."""
    for batch in batches:
        start, ends = 0, np.cumsum(_weight(batch))
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + portion_bytes, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        release()


def release() -> None:
    """Give freed memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def per_block(docs: DataFrame, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def run(batches):
        for block, rows in iter_blocks(batches, block_bytes):
            yield from fn(block, rows)
            del rows
            release()
    return docs.mapInArrow(run, schema)


def packed_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: its id and its rows as a compressed Arrow stream."""
    def pack(block, rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        data = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})
    return per_block(docs, pack, "block bigint, data binary", block_bytes)


def unpack_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def byte_values(column: pa.ChunkedArray) -> list[bytes]:
    """A text column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ------------------------------------------------------------------ sorted keys
def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    s = np.sort(values)
    if not len(s):
        return s, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (sorted distinct keys, counts) pairs."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring keys land in unrelated shards."""
    x = keys.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class KeyMap:
    """Distinct uint64 keys to positions, open addressing, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys.astype(np.uint64)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot, the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slot[at]
            out[open_] = got
            on = (got >= 0) & (self.keys[got] != keys[open_])
            open_, at = open_[on], at[on]
        return out


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    planes = unsqueeze(data, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)
