"""Sharded count joins between blocks of documents and tables of keyed counts.

Each block asks once for every distinct key it holds.  Requests are dealt to
shards by a hash of the key, counted there, turned into values by DataFrame
joins over the distinct keys, answered shard by shard and brought back to the
blocks.  No task holds more than a shard or a block; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planwise.llm.common import merged, mixed, release, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted

REQUEST = "block bigint, kind int, shard bigint, n_keys bigint, keys binary, counts binary"
COUNTED = "kind int, shard bigint, key bigint, n bigint"
ANSWER = "block bigint, kind int, shard bigint, keys binary, vals binary"


def request_rows(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Requests of one block: sorted distinct keys with their training counts, cut by shard."""
    if not len(keys):
        return
    shard = (mixed(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(at[1:], len(shard))
    n = len(at)
    yield pa.RecordBatch.from_pydict({
        "block": pa.array([block] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()),
        "shard": pa.array(shard[at]), "n_keys": pa.array(ends - at),
        "keys": pa.array([squeeze_sorted(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
        "counts": pa.array([squeeze(counts[a:b]) for a, b in zip(at, ends)], pa.binary())})


def counted(requests: DataFrame) -> DataFrame:
    """(kind, shard, key, n) for every key asked for; n is its count in training blocks, maybe 0."""
    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        release()  # what the shard before it took
        parts = [(unsqueeze_sorted(k), unsqueeze(c, np.int64))
                 for k, c in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist())]
        keys, n = merged(parts)
        return pa.table({"kind": pa.array([key[0].as_py()] * len(keys), pa.int32()),
                         "shard": pa.array([key[1].as_py()] * len(keys), pa.int64()),
                         "key": pa.array(keys.view(np.int64)), "n": pa.array(n)})
    return requests.groupBy("kind", "shard").applyInArrow(count, COUNTED)


def answers(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Values for each request row, in the order of its keys; ``values`` is (kind, shard, key, value double)."""
    def answer(asked: pa.Table, have: pa.Table) -> pa.Table:
        release()
        keys = have["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, vals = keys[order], have["value"].to_numpy()[order]
        out = []
        for data in asked["keys"].to_pylist():
            want = unsqueeze_sorted(data)
            at = np.searchsorted(keys, want)
            if len(want) and (len(keys) == 0 or at.max() >= len(keys) or not (keys[at] == want).all()):
                raise RuntimeError("a requested key has no value: the input changed between two reads of it")
            out.append(squeeze(vals[at].astype(np.float64).view(np.uint8).reshape(-1, 8).T))
        return pa.table({"block": asked["block"].cast(pa.int64()), "kind": asked["kind"].cast(pa.int32()),
                         "shard": asked["shard"].cast(pa.int64()), "keys": asked["keys"].cast(pa.binary()),
                         "vals": pa.array(out, pa.binary())})
    return (requests.groupBy("kind", "shard").cogroup(values.groupBy("kind", "shard"))
            .applyInArrow(answer, ANSWER))


def read_answers(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of one kind that a block asked for, with their values."""
    keys, vals = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for k, key, val in zip(rows["kind"].to_pylist(), rows["keys"].to_pylist(), rows["vals"].to_pylist()):
        if k == kind:
            keys.append(unsqueeze_sorted(key))
            vals.append(np.ascontiguousarray(unsqueeze(val, np.uint8).reshape(8, -1).T).view(np.float64).ravel())
    return np.concatenate(keys), np.concatenate(vals)
